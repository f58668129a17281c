import json

import pytest

from plurality import cli


def test_parsers():
    assert cli.whole_numbers("1, 2,16") == (1, 2, 16) and cli.numbers("0,0.5") == (0.0, 0.5)
    assert cli.model_specs(["a=/x/y@b", "/p/q/"]) == [{"name": "a", "path": "/x/y", "base": "b"}, {"name": "q", "path": "/p/q/", "base": "q"}]
    for wrong in (["a=/x", "a=/y"], ["=/x"], ["a="]):
        with pytest.raises(ValueError):
            cli.model_specs(wrong)
    args = cli.parser().parse_args("evaluate --pool a --expected b --out c --targets 4,8".split())
    assert args.targets == (4, 8) and args.phase == "analysis"
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["evaluate"])


def test_queries_and_run(spark, tmp_path, capsys):
    assert cli.main(["queries"]) == 0 and "relssc_winner" in capsys.readouterr().out.split()
    assert cli.main(["run", "relssc_winner", "--tables", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0


def test_validation_then_test(spark, tmp_path):
    for half in ("v", "t"):
        with open(tmp_path / f"{half}.jsonl", "w") as out:
            for q in range(6):
                for i in range(16):
                    out.write(json.dumps({"question_id": f"{half}{q}", "pos": i, "answer": "AB"[(i * (q + 1)) % 3 == 0], "confidence": (i % 10) / 10, "split": half}) + "\n")
        (tmp_path / f"{half}_gold.jsonl").write_text("".join(json.dumps({"question_id": f"{half}{q}", "gold": "A"}) + "\n" for q in range(7)))
    common = ["--budgets", "4,16", "--targets", "8", "--cap", "16", "--thresholds", "0,0.5,1", "--model", "m", "--dataset", "d"]
    path = lambda name: str(tmp_path / name)
    cli.main(["evaluate", "--pool", path("v.jsonl"), "--expected", path("v_gold.jsonl"), "--phase", "validation", "--out", path("rv"), "--save-artifact", path("a"), *common])
    cli.main(["evaluate", "--pool", path("t.jsonl"), "--expected", path("t_gold.jsonl"), "--phase", "test", "--artifact", path("a"), "--out", path("rt"), *common])
    rows = spark.read.option("header", True).csv(path("rt/rows.csv"))
    matches = rows.where("row_type = 'dynamic_budget_match'").collect()
    assert len(matches) == 5 and all(r.questions_total == "7" and r.questions_observed == "6" and float(r.actual_avg_samples) <= 8 for r in matches)
    with pytest.raises(ValueError, match="other_model"):
        cli.main(["evaluate", "--pool", path("t.jsonl"), "--expected", path("t_gold.jsonl"), "--phase", "test", "--artifact", path("a"), "--out", path("x"), *common[:-3], "other", "--dataset", "d"])
