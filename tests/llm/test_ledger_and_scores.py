"""The ledger across runs, rows that repeat, and scores of personal data."""

import fixture

from tessera.llm import pii, secrets
from tessera.llm.queries import QUERIES


def test_ledger_in_a_folder(spark, tmp_path, monkeypatch):
    one = fixture.write(tmp_path / "1", [(1, 'token = "abcdef1"', "en", "s"), (2, "plain", "en", "s")])
    two = fixture.write(tmp_path / "2", [(1, 'token = "abcdef1"', "en", "s"), (3, 'token = "abcdef2"', "en", "s"), (4, None, "en", "s")])
    folder = str(tmp_path / "ledger")
    spark.conf.set("spark.tessera.secrets.ledger", folder)
    try:
        first = QUERIES["op10_secrets"](spark, one).collect()
        assert spark.read.parquet(folder).count() == 2
        second = QUERIES["op10_secrets"](spark, two).collect()
        assert spark.read.parquet(folder).count() == 4
    finally:
        spark.conf.unset("spark.tessera.secrets.ledger")
    assert {r["doc_id"]: r["n_assign"] for r in first} == {1: 1, 2: 0}
    assert sorted(map(str, second)) == sorted(map(str, QUERIES["op10_secrets"](spark, two).collect()))
    monkeypatch.setattr(secrets, "RULE_VERSION", secrets.RULE_VERSION + 1)
    d = spark.read.parquet(one + "/documents.parquet")
    assert secrets.scan(d, "doc_id", ledger=secrets.read_ledger(spark, folder))[1].count() == 2


def test_equal_rows_share_one_scan(spark, tmp_path):
    from tessera.llm import spans

    seen = spark.sparkContext.accumulator(0)
    real = spans.scanner

    def counting(*a):
        inner = real(*a)

        def run(batches):
            def tap():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            return inner(tap())

        return run

    d = spark.createDataFrame([(1, 'secret: "abcdefgh"', "x", "y")] * 300 + [(i, 'secret: "abcdefgh"', "x", "y") for i in range(2, 40)], "doc_id long, text string, _blob string, _at string")
    secrets.S.scanner = counting
    try:
        found, fresh = secrets.scan(d, "doc_id")
        assert fresh.count() == 1 and found.where("n_assign = 1").count() == 338
    finally:
        secrets.S.scanner = real
    assert seen.value == 1


def test_scores(spark):
    text = "Call 555-123-4567 or SSN 123-45-6789, 321-54-9876 far off from all such words as these are: " + "x " * 40 + "210-54-9876 and 555-123-9999; mail a@b.org, card 4111 1111 1111 1111"
    spans = {(k, text[a:b]): s for k, a, b, s in pii.find(text)}
    assert spans[("phone", "555-123-4567")] == spans[("ssn", "123-45-6789")] == 0.6
    assert ("ssn", "210-54-9876") not in spans and ("phone", "555-123-9999") not in spans
    assert spans[("card", "4111 1111 1111 1111")] == 1.0 and all(0 <= s <= 1 for s in spans.values())
    (row,) = pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).collect()
    assert len(row["scores"].split(",")) == len(row["spans"].split(",")) == len(spans)
