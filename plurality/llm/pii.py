"""Personal data: base patterns, and a linear-chain conditional random field.

The field tags words with ``O`` or the beginning or inside of a kind. A word has features of
its shape and, where it is a cue, of itself; its score also sees both neighbours' features.
Weights are fitted to the likelihood of a small labelled table by forward-backward sums.
Sentences of a batch are decoded together, sorted by length, by Viterbi over numpy arrays.
What the field tags is kept where it has the digits or parts its kind needs and touches no
base span, so base spans stay as they are.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plurality.llm.common import map_batches, texts

KINDS = ["email", "ip", "card", "phone"]
STATES = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
#: Rows of a labelled table used at most; the field is fitted on the driver.
MAX_TABLE_ROWS = 5_000

# The base patterns, after what anchors them.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGITS = re.compile("[0-9]")
#: Words from which a sentence without a stop is cut at the next plain word that is no cue.
LONG_SENTENCE = 512


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the base patterns, by kind, then start.

    A local part is the run of its characters before an ``@``, an address the run of digits
    from its first on, so neither scan goes back over what it has read.
    """
    out = []
    if "@" in text:
        past, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > past and text[start - 1] in LOCAL:
                start -= 1
            found = DOMAIN.match(text, at + 1) if start < at else None
            if found:
                out.append((0, start, found.end()))
                past = found.end()
            else:
                past = at + 1
            at = text.find("@", past)
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# ---- features -------------------------------------------------------------------------

CUES = frozenset("at dot email e-mail mail phone tel call mobile fax card visa number ip address host server version on in of for".split())
EDGE = " \t\n\"'.,;:!?)]}>([{<"


def features(word: str) -> tuple[str, ...]:
    """Shape (runs of one class written once), size, and cue features of a word."""
    head = word[:-1] if word[-1] in ".,;:!?" else word
    if head.isalpha() and (head.islower() or head.istitle()):  # most words: no need to look at each letter
        shape = ("x" if head.islower() else "X" if len(head) == 1 else "Xx") + word[len(head) :]
        out = [f"s:{shape}", "d:0", f"n:{min(len(word), 12)}"]
        if head.lower() in CUES:
            out.append(f"c:{head.lower()}")
        if word[-1] in ".!?":
            out.append("end")
        return tuple(out)
    core = word.strip(EDGE).lower() or word
    shape, last = [], ""
    for c in word[:40]:
        kind = "d" if "0" <= c <= "9" else "x" if c.islower() else "X" if c.isupper() else c if c.isascii() else "?"
        if kind != last:
            shape.append(kind)
        last = kind
    digits = sum("0" <= c <= "9" for c in word)
    bracketed = word[:1] in "([{<" and word[-1:] in ")]}>"
    out = [f"s:{''.join(shape)[:14]}", f"d:{min(digits, 17)}", f"n:{min(len(word), 12)}"]
    if core in CUES:
        out.append(f"c:{core}")
        if bracketed:
            out.append(f"b:{core}")
    if word[-1:] in ".!?":
        out.append("end")
    return tuple(out)


# ---- the labelled table ---------------------------------------------------------------


def labelled_table(rows: int = 420, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Invented sentences with tags: each kind in common spellings, and look-alikes."""
    rng = random.Random(seed)
    syllables = "an be co da el fi go ha in jo ka le mi no or pa re sa ti un ver wo".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def plain() -> list[tuple[str, str]]:
        out = [(word() + rng.choice(["", "", "", ",", "."]), "O") for _ in range(rng.randint(1, 7))]
        return [(w.capitalize() if rng.random() < 0.1 else w, t) for w, t in out]

    def tagged(kind: str, words: list[str]) -> list[tuple[str, str]]:
        return [(w, f"{'I' if i else 'B'}-{kind}") for i, w in enumerate(words)]

    def email() -> list[str]:
        at, dot = rng.choice([("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]"), ("AT", "DOT")])
        return rng.choice([[f"{word()}.{word()}@{word()}.com"], [word(), at, word(), dot, "com"], [word(), at, f"{word()}.org"], [f"{word()}{at if at[0] in '([' else '(at)'}{word()}.net"]])

    def ip() -> list[str]:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice([[".".join(parts)], ["[.]".join(parts)], ["(dot)".join(parts)]])

    def card() -> list[str]:
        parts = [digits(4) for _ in range(4)]
        return rng.choice([parts, ["".join(parts)], [".".join(parts)], ["-".join(parts)], ["/".join(parts)]])

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([[f"{a}-{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"+1", f"({a})", f"{b}-{c}"], [f"{a}.{b}.{c}"], [f"({a})", b, c], [f"+{digits(2)}", a, b, c]])

    lookalike = [
        lambda: [str(rng.randint(1, 99999))], lambda: [f"{rng.randint(1900, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}"], lambda: [f"{rng.randint(1, 23)}:{rng.randint(10, 59)}"],
        lambda: [f"{rng.randint(1, 999)},{digits(3)}.{digits(2)}"], lambda: [f"v{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}"], lambda: ["meet", "at", word()],
        lambda: ["the", "dot", word()], lambda: [f"{word().upper()}!!"], lambda: [f"{word()}{rng.choice(['***', '$$$', '###', '|'])}"], lambda: [f"http://{word()}.example.com/{digits(4)}"], lambda: [digits(rng.randint(20, 30))],
    ]
    makers = {"email": (email, ["email", "mail", "write"]), "ip": (ip, ["host", "server", "ip"]), "card": (card, ["card", "visa", "number"]), "phone": (phone, ["phone", "call", "tel"])}
    out = []
    for i in range(rows):
        line = plain()
        if i % 2:
            kind = KINDS[i // 2 % 4]
            make, cues = makers[kind]
            if rng.random() < 0.5:
                line.append((rng.choice(cues), "O"))
            line += tagged(kind, make())
        else:
            line += [(w, "O") for w in rng.choice(lookalike)()]
        line += plain()
        out.append(([w for w, _ in line], [t for _, t in line]))
    return out


class Field:
    """Weights of the field: feature index, emissions for three offsets, transitions."""

    def __init__(self, table: list[tuple[list[str], list[str]]], rounds: int = 120, l2: float = 2e-3):
        names = sorted({f for words, _ in table for w in words for f in features(w)})
        self.index = {f: i + 1 for i, f in enumerate(names)}
        self.emit = np.zeros((3, len(names) + 1, len(STATES)))
        self.moves = np.zeros((len(STATES), len(STATES)))
        self.start = np.zeros(len(STATES))
        self.banned = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in STATES] for a in STATES])
        self.banned_start = np.array([s.startswith("I-") for s in STATES])
        self._train([(w, t) for w, t in table if w], rounds, l2)

    def ids(self, word: str) -> list[int]:
        return [self.index[f] for f in features(word) if f in self.index]

    def _train(self, table, rounds, l2) -> None:
        states = {s: i for i, s in enumerate(STATES)}
        m, width, k = len(table), max(len(w) for w, _ in table), len(STATES)
        deep = 6
        feats = np.zeros((m, width + 2, deep), np.int64)  # a word further at both ends
        gold, mask = np.zeros((m, width), np.int64), np.zeros((m, width), bool)
        for i, (words, tags) in enumerate(table):
            for j, (w, t) in enumerate(zip(words, tags, strict=True)):
                got = self.ids(w)[:deep]
                feats[i, j + 1, : len(got)] = got
                gold[i, j], mask[i, j] = states[t], True
        views = [feats[:, o : o + width] for o in (1, 0, 2)]  # itself, before, after
        params = [self.emit, self.moves, self.start]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rows = np.arange(m)
        lengths = mask.sum(1)
        for step in range(1, rounds + 1):
            moves, start = np.where(self.banned, -30, self.moves), np.where(self.banned_start, -30, self.start)
            scores = sum(self.emit[o][v].sum(2) for o, v in enumerate(views))
            alpha, beta = np.zeros((m, width, k)), np.zeros((m, width, k))
            alpha[:, 0] = start + scores[:, 0]
            for j in range(1, width):
                alpha[:, j] = np.logaddexp.reduce(alpha[:, j - 1, :, None] + moves, axis=1) + scores[:, j]
            for j in range(width - 2, -1, -1):
                back = np.logaddexp.reduce(moves + (scores[:, j + 1] + beta[:, j + 1])[:, None, :], axis=2)
                beta[:, j] = np.where((j < lengths - 1)[:, None], back, 0)
            total = np.logaddexp.reduce(alpha[rows, lengths - 1], axis=1)
            single = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
            want = np.zeros_like(single)
            want[rows[:, None], np.arange(width), gold] = mask
            diff = (want - single) / m
            grad = [np.zeros_like(p) for p in params]
            for o, view in enumerate(views):
                for d in range(deep):
                    np.add.at(grad[0][o], view[:, :, d], diff)
            grad[0][:, 0] = 0
            grad[2] += diff[:, 0].sum(0)
            for j in range(1, width):
                inside = mask[:, j]
                pair = np.exp(alpha[:, j - 1, :, None] + moves + (scores[:, j] + beta[:, j])[:, None, :] - total[:, None, None])
                grad[1] -= pair[inside].sum(0) / m
                np.add.at(grad[1], (gold[inside, j - 1], gold[inside, j]), 1 / m)
            for p, g, a, b in zip(params, grad, first, second, strict=True):
                g -= l2 * p
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p += 0.2 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)


@functools.lru_cache(maxsize=1)
def default_field() -> Field:
    return Field(labelled_table())


#: The tagger of this worker, with what it remembers of words, by its field.
TAGGERS: dict[bytes, Tagger] = {}


def tagger_of(field: Field) -> Tagger:
    key = hashlib.sha256(field.emit.tobytes() + field.moves.tobytes() + field.start.tobytes()).digest()
    if key not in TAGGERS:
        TAGGERS.clear()
        TAGGERS[key] = Tagger(field)
    return TAGGERS[key]


def forget_words() -> None:
    TAGGERS.clear()


#: Bits of a word's code below its feature row: it ends a sentence; a long one may end here.
ENDS, PLAIN = 1, 2


class Codes(dict):
    """Of each distinct word its feature row and what it is to a sentence, in one number."""

    MOST = 200_000

    def __init__(self, tagger: Tagger):
        super().__init__()
        self.tagger = tagger

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        # a sentence ends at a stop after a letter; numbers may hold stops
        ends = ENDS if word[-1] in ".!?" and word[-2:-1].isalpha() else 0
        plain = PLAIN if word.isalpha() and word.lower() not in CUES else 0
        code = self[word] = self.tagger.row(word) << 2 | plain | ends
        return code


class Tagger:
    """Decodes batches of sentences; remembers the feature row of each distinct word."""

    CELLS = 400_000

    def __init__(self, field: Field):
        self.field = field
        self.rows: dict[tuple[int, ...], int] = {(): 0}
        self.simple: dict[tuple, int] = {}
        self.codes = Codes(self)
        self.table = np.zeros((3, 1, len(STATES)))
        self.moves = np.where(field.banned, -30, field.moves)
        self.start = np.where(field.banned_start, -30, field.start)

    def row(self, word: str) -> int:
        """The word's feature row. Features of lower-case and title words hang on few things,
        so their rows are told by those."""
        head = word[:-1] if word[-1] in ".,;:!?" else word
        if not (head.isalpha() and ((lower := head.islower()) or head.istitle())):
            return self._row(word)
        cue = head if lower else head.lower()
        few = lower, len(head) == 1, word[len(head) :], min(len(word), 12), cue if cue in CUES else ""
        found = self.simple.get(few)
        if found is None:
            found = self.simple[few] = self._row(word)
        return found

    def _row(self, word: str) -> int:
        key = tuple(self.field.ids(word))
        found = self.rows.get(key)
        if found is None:
            found = self.rows[key] = len(self.rows)
            new = self.field.emit[:, list(key)].sum(1)
            self.table = np.concatenate([self.table, new[:, None]], axis=1)
        return found

    def decode(self, sentences: list[list[int]]) -> list[np.ndarray | None]:
        """States of each sentence (as rows of words), None where all are ``O``."""
        out: list[np.ndarray | None] = [None] * len(sentences)
        order = sorted(range(len(sentences)), key=lambda i: len(sentences[i]))
        at = len(order)
        while at > 0:
            width = len(sentences[order[at - 1]])
            low = max(0, at - max(1, self.CELLS // (width + 1)))
            while low < at - 1 and len(sentences[order[low]]) < width // 2:
                low += 1 + (at - 1 - low) // 2
            group, at = order[low:at], low
            if width:
                self._group(sentences, group, width, out)
        return out

    def _group(self, sentences, group, width, out) -> None:
        m, k = len(group), len(STATES)
        rows, lengths = np.zeros((m, width + 2), np.int64), np.array([len(sentences[i]) for i in group])
        for r, i in enumerate(group):
            rows[r, 1 : 1 + lengths[r]] = sentences[i]
        scores = self.table[0][rows[:, 1:-1]] + self.table[1][rows[:, :-2]] + self.table[2][rows[:, 2:]]
        best = self.start + scores[:, 0]
        back = np.zeros((width, m, k), np.int8)
        final = best.copy()
        for j in range(1, width):
            reach = best[:, :, None] + self.moves
            back[j] = reach.argmax(1)
            best = np.take_along_axis(reach, back[j][:, None, :].astype(np.int64), 1)[:, 0] + scores[:, j]
            live = lengths > j
            final[live] = best[live]
        state = final.argmax(1)
        path = np.zeros((m, width), np.int8)
        index = np.arange(m)
        for j in range(width - 1, -1, -1):
            here = lengths > j
            path[here, j] = state[here]
            if j:
                state = np.where(here, back[j][index, state], state)
        for r in np.flatnonzero(path.any(1)):
            out[group[r]] = path[r, : lengths[r]]


def plausible(kind: str, piece: str) -> bool:
    """What a tagged span must hold to be reported."""
    digits = "".join(DIGITS.findall(piece))
    if kind == "email":
        return re.fullmatch(r"(?i)[a-z0-9._%+-]+\s*(?:@|\s(?:at)\s|[(\[{<]\s*at\s*[)\]}>])\s*[a-z0-9-]+(?:\s*(?:\.|\s(?:dot)\s|[(\[{<]\s*dot\s*[)\]}>])\s*[a-z0-9-]+)+", piece) is not None
    if kind == "ip":
        parts = re.split(r"\[\.\]|\(\.\)|\(dot\)|\[dot\]|\.", piece)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9\s./_-]+", piece) is not None
    return 9 <= len(digits) <= 15 and re.fullmatch(r"\+?[0-9()\s./-]+", piece) is not None and re.search(r"[()\s./-]", piece) is not None


def field_spans(text: str, words: list[re.Match], tags: np.ndarray, at: int) -> list[tuple[int, int, int]]:
    """Tagged spans of a sentence whose words begin at index ``at`` of ``words``."""
    out, j = [], 0
    while j < len(tags):
        if tags[j] % 2 == 0:  # O, or an inside without its beginning
            j += 1
            continue
        kind, stop = (tags[j] - 1) // 2, j + 1
        while stop < len(tags) and tags[stop] == tags[j] + 1:
            stop += 1
        start, end = words[at + j].start(), words[at + stop - 1].end()
        piece = text[start:end]
        left = len(piece) - len(piece.lstrip("\"'.,;:!?])}>{<"))
        start += left
        end -= len(piece) - len(piece.rstrip("\"'.,;:!?({[<"))
        if start < end and plausible(KINDS[kind], text[start:end]):
            out.append((int(kind), start, end))
        j = stop
    return out


def scan(rows: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    sentences, places = [], []
    for r, text in enumerate(rows):
        words = WORD.findall(text)
        codes = np.fromiter(map(tagger.codes.__getitem__, words), np.int64, len(words))
        begin = 0
        for end in [*(np.flatnonzero(codes & ENDS) + 1).tolist(), len(words)]:
            while end - begin > LONG_SENTENCE:
                later = np.flatnonzero(codes[begin + LONG_SENTENCE : end] & PLAIN)
                if not len(later):
                    break
                cut = begin + LONG_SENTENCE + int(later[0]) + 1
                sentences.append(codes[begin:cut] >> 2)
                places.append((r, begin))
                begin = cut
            if begin < end:
                sentences.append(codes[begin:end] >> 2)
                places.append((r, begin))
            begin = end
    added: list[list] = [[] for _ in rows]
    matches: dict[int, list[re.Match]] = {}  # places of words, of texts that need them
    for tags, (r, begin) in zip(tagger.decode(sentences), places, strict=True):
        if tags is not None:
            if r not in matches:
                matches[r] = list(WORD.finditer(rows[r]))
            added[r] += field_spans(rows[r], matches[r], tags, begin)
    out = []
    for text, more in zip(rows, added, strict=True):
        base = base_spans(text)
        out.append((base, [x for x in more if not any(s < x[2] and x[1] < e for _, s, e in base)]))
    return out


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: base counts, their digest, and all spans.

    Columns ``id, n_email, n_ip, n_card, n_phone, base_sha256, spans``; spans are
    ``kind:start:end`` in code points by kind, then start. ``field`` is fitted from
    ``labelled_table()`` unless given. Null and empty texts have no spans; a null id and
    repeated rows stay. Texts of any length are read whole; a sentence without a stop is cut
    after ``LONG_SENTENCE`` words. One pass, no shuffle; the field's size does not follow the
    data.
    """
    field = field or default_field()
    kind = dict(docs.dtypes)[id_col]

    def step(ids: pa.Array, column: pa.Array) -> pa.RecordBatch:
        done = scan(texts(column), tagger_of(field))
        counts = [pa.array([sum(k == n for k, _, _ in base) for base, _ in done], pa.int64()) for n in range(len(KINDS))]
        digests = pa.array([hashlib.sha256(span_text(base).encode()).hexdigest() for base, _ in done], pa.string())
        return pa.RecordBatch.from_arrays([ids, *counts, digests, pa.array([span_text(b + a) for b, a in done], pa.string())], [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return map_batches(docs, [id_col, text_col], step, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string", forget_words)
