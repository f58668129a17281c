import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plurality.llm import pii

PLAIN = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(d := re.sub("[^0-9]", "", t)) <= 19 and pii.luhn(d)),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15),
]


def brute(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m[0])]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+0123459 ()é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_of_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    for r in rows:
        assert pii.base_spans(r.text) == brute(r.text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_viterbi_equals_enumeration():
    field = pii.default_field()
    tagger = pii.Tagger(field)
    words = "call (555) 123-4567 now or bob (at) host (dot) com".split()
    for cut in ([0, 4], [4, 9], [1, 3], [0, 1]):
        line = [tagger.row(w) for w in words[cut[0] : cut[1]]]
        got = tagger.decode([line, [], line[:1]])[0]
        got = np.zeros(len(line), int) if got is None else got
        pad = [0, *line, 0]
        score = np.array([tagger.table[0][pad[j + 1]] + tagger.table[1][pad[j]] + tagger.table[2][pad[j + 2]] for j in range(len(line))])

        def total(path, score=score):
            return tagger.start[path[0]] + sum(score[j, s] for j, s in enumerate(path)) + sum(tagger.moves[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(total(p) for p in np.ndindex(*[len(pii.STATES)] * len(line)))
        assert abs(total(tuple(got)) - best) < 1e-9


def test_field_on_unseen_rows():
    tagger = pii.Tagger(pii.default_field())
    right = n = 0
    for words, tags in pii.labelled_table(300, seed=99):
        got = tagger.decode([[tagger.row(w) for w in words]])[0]
        got = np.zeros(len(words), int) if got is None else got
        right += sum(pii.STATES[g] == t for g, t in zip(got, tags, strict=True))
        n += len(tags)
    print("held-out tag accuracy", right / n)
    assert right / n > 0.97


def test_frames(spark):
    rows = [
        (1, "é mail bob.x@mail.example.com or call (532) 555-7857 now."),
        (2, None),
        (3, ""),
        (None, "write joan (at) host (dot) com today, ip 10[.]0[.]0[.]1 please"),
        (1, "é mail bob.x@mail.example.com or call (532) 555-7857 now."),
        (4, "The heon to, of nd he 4111 1111 1111 1111 and 99.171.88.88 there. +1 (684) 555-1175."),
        (5, "no such thing 2024-05-01, 12:30 or 1,234.56 in version 1.2.3 here"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS spans").coalesce(1)
    got = [r.asDict() for r in pii.personal_data(docs).collect()]
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    for r, (_, text) in zip(got, rows, strict=True):
        base = brute(text or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.span_text(base).encode()).hexdigest()
        assert set(filter(None, pii.span_text(base).split(","))) <= set(r["spans"].split(","))
    assert got[0]["spans"] == "email:7:29,phone:38:52" and got[0] == got[4]
    assert got[3]["spans"].startswith("email:6:30,ip:41:55") and got[6]["spans"] == ""
    assert pii.personal_data(docs.limit(0)).count() == 0


#: Written by hand, not by the generator of the labelled table: text and what is in it.
BY_HAND = [
    ("Please reach Maria under maria (at) orchard (dot) net before noon.", ["maria (at) orchard (dot) net"]),
    ("My e-mail is tom at lakehouse dot org, thanks!", ["tom at lakehouse dot org"]),
    ("Contact: sales[at]widgets.com", ["sales[at]widgets.com"]),
    ("Call me on (415) 555-0134 after six.", ["(415) 555-0134"]),
    ("Our number: 212-555-0187 or 212.555.0199.", ["212-555-0187", "212.555.0199"]),
    ("Fax (030) 555 0147, room 12.", ["(030) 555 0147"]),
    ("The server at 192[.]168[.]0[.]44 was down.", ["192[.]168[.]0[.]44"]),
    ("Blocked host 10(dot)0(dot)7(dot)23 again", ["10(dot)0(dot)7(dot)23"]),
    ("Card 4111.1111.1111.1111 was charged twice.", ["4111.1111.1111.1111"]),
    ("visa 5500/0000/0000/0004 expired", ["5500/0000/0000/0004"]),
    ("Meet at the dot matrix printer on floor 3.", []),
    ("We saw 1,234.56 dollars at 12:30 on 2024-05-01.", []),
    ("Version 3.11.4 of the library, pages 100-200.", []),
    ("At dawn the dot on the map was gone.", []),
    ("Order 20240501 has 555 items; call it a day.", []),
    ("He scored 98 at home and 87 on the road.", []),
]


def test_recall_and_precision_on_sentences_written_by_hand():
    found = right = wanted = 0
    for text, want in BY_HAND:
        base, added = pii.scan([text], pii.tagger_of(pii.default_field()))[0]
        spans = [text[s:e] for _, s, e in added]
        assert base == []
        found, wanted = found + len(spans), wanted + len(want)
        right += len(set(spans) & set(want))
    print(f"added spans: recall {right}/{wanted}, precision {right}/{found}")
    assert right >= 0.7 * wanted and right >= 0.8 * found


def test_long_sentences_are_cut_without_losing_spans():
    text = "lorem ipsum " * 5000 + "write joan (at) host (dot) com " + "12 34 " * 3000 + "call (532) 555-7857 " + "dolor " * 2000
    short = "write joan (at) host (dot) com and call (532) 555-7857 dolor"
    tagger = pii.tagger_of(pii.default_field())
    pieces = lambda t: sorted(t[s:e] for _, s, e in pii.scan([t], tagger)[0][1])
    assert pieces(text) == pieces(short) != []


#: Sentences written by hand around values drawn at random, in forms that the base patterns do
#: not know.
FRAMES = {
    "email": [
        "For refunds, reach out to {} by Friday.", "I can be found under {} most days", "Kindly forward the minutes: {}", "The organiser ({}) never replied to us.",
        "Send photos of the damage to {} please.", "Her private e-mail was {} back then.", "Applications go to {} until the end of March.", "Reply to {} if the link is broken",
    ],
    "ip": [
        "The gateway sits behind {} in the lab.", "Traffic from {} was dropped last night", "Ping {} before you restart it.", "Our backup host moved to {} in May.",
        "Someone logged in from {} twice.", "The printer answers under {} again.", "Route everything over {} for now", "Bad requests came from server {} only.",
    ],
    "card": [
        "The hotel charged card {} without asking.", "Please delete visa {} from my account", "Payment with {} was declined at noon.", "Use the company card {} for the flights.",
        "He read out {} over the line.", "My old card {} has expired.", "Refund it to card {} if you can", "The receipt shows card number {} in full.",
    ],
    "phone": [
        "Ring the porter on {} after ten.", "You can call {} for a table", "The hotline {} was busy all day.", "Her mobile is {} while she travels.",
        "Text {} when you arrive.", "Tel. {} is answered in the mornings.", "If lost, phone {} at once", "The clinic moved; call {} instead.",
    ],
}
CLEAN = [
    "At noon the dot on the screen moved left.", "The score was 21 to 17 at half time.", "Chapter 4.2 starts on page 118.", "Flight 4471 leaves at 06:45 from gate 12.", "They sold 1,250 tickets in 3 days.", "The recipe needs 250 g of flour and 2 eggs.",
    "In 1987 the mill burnt down.", "Build 10.4.1 fixed the bug.", "Look at the map, then at the dot near the river.", "Room 204 is on the second floor.", "It costs 12.50 or 11.90 with a card.", "Call it what you like, it works.",
    "The host of the evening sang twice.", "Our phone rang during dinner.", "The server brought the soup cold.", "Mail arrives before ten in the morning.", "He ran 10 km in 41:30.", "She wrote 3 letters and 40 postcards.", "Bus 55 stops at the old tower.", "On 3 of 12 days it rained.",
]


def drawn(kind, rng):
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abdefgiklmnoprstu") for _ in range(rng.randrange(4, 9)))
    if kind == "email":
        user, host, end = word() + rng.choice(["", n(2)]), word(), rng.choice(["com", "org", "net", "de"])
        return rng.choice([f"{user} (at) {host} (dot) {end}", f"{user} at {host} dot {end}", f"{user}[at]{host}.{end}", f"{user} (at) {host}.{end}"])
    if kind == "ip":
        return rng.choice(["[.]", "(dot)", "(.)"]).join(str(rng.randrange(1, 255)) for _ in range(4))
    if kind == "card":
        digits = "4" + n(14)
        check = next(d for d in "0123456789" if pii.luhn(digits + d))
        mark = rng.choice("./")
        return mark.join((digits + check)[i : i + 4] for i in range(0, 16, 4))
    return rng.choice([f"({n(3)}) {n(3)}-{n(4)}", f"{rng.randrange(201, 989)}-{n(3)}-{n(4)}", f"{rng.randrange(201, 989)}.{n(3)}.{n(4)}"])


def test_recall_and_precision_by_kind_on_160_values():
    import random

    rng, tagger = random.Random(21), pii.tagger_of(pii.default_field())
    told, extra = {}, 0
    for kind, frames in FRAMES.items():
        for frame in frames * 5:
            value = drawn(kind, rng)
            text = frame.format(value)
            spans = {text[s:e] for _, s, e in pii.scan([text], tagger)[0][1]}
            hits, n = told.get(kind, (0, 0))
            told[kind] = hits + (value in spans), n + 1
            extra += len(spans - {value})
    false = sum(len(added) for _, added in pii.scan(CLEAN, tagger))
    print("added spans, recall by kind:", told, "wrong:", extra, "in sentences without any:", false)
    assert sum(n for _, n in told.values()) == 160
    assert sum(h for h, _ in told.values()) >= 0.8 * 160 and extra <= 8 and false <= 1
