"""Context around a span on both sides, in lists and columns; keys that name themselves."""

import pytest

from coppice.llm import pii

HEX, OTHER = "0f" * 20, "1e" * 20
AKIA, GHP = "AKIA" + "ABCD2345" * 2, "ghp_" + "aB3" * 12
CASES = [
    ("SSN: 123-45-6789, 234-56-7890", ["123-45-6789", "234-56-7890"]),
    ("ssn\n" + "\n".join(f"{k}-45-6789" for k in range(100, 140)), [f"{k}-45-6789" for k in range(100, 140)]),
    ("123-45-6789 is my SSN", ["123-45-6789"]),
    ("part 123-45-6789 and 234-56-7890", []),
    ("SSN 123-45-6789" + " word" * 20 + " 234-56-7890", ["123-45-6789"]),
    (f"aws_access_key_id = {AKIA}", [AKIA]),
    (f"Authorization: token {GHP}", [GHP]),
    (f"token={HEX}, {OTHER}", [HEX, OTHER]),
    (f"commit {HEX}", []),
    ("🙂 SSN: é 123-45-6789; 234-56-7890", ["123-45-6789", "234-56-7890"]),
]


@pytest.mark.parametrize("column", ["spans", "redacted"])
def test_context(spark, column):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "doc_id long, text string")
    if column == "spans":
        got = {r.doc_id: [CASES[r.doc_id][0][x.start : x.end] for x in r.spans if x.kind >= pii.BASE] for r in pii.spans(docs).collect()}
        assert got == {k: want for k, (_, want) in enumerate(CASES)}
    else:
        for r in pii.redact(docs).collect():
            assert not any(x in r.text for x in CASES[r.doc_id][1])


SCORED = [
    ("pay by credit card 4111 1111 1111 1111 now", "card", 100),
    ("number 4111 1111 1111 1111 now", "card", 60),
    ("tracking 4111 1111 1111 1111 now", "card", 20),
    ("call +49 30 1234 5678", "phone", 90),
    ("version 1.2.3.4", "ip", 20),
    ("my iban DE89 3704 0044 0532 0130 00", "iban", 100),
    ("code DE89 3704 0044 0532 0130 00", "iban", 60),
    ("order DE89 3704 0044 0532 0130 00", None, None),
]


def test_scores(spark):
    """Words around a span move its score; base spans stay at any, others go below 50."""
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(SCORED)], "doc_id long, text string")
    for r in pii.report(docs).collect():
        _, kind, score = SCORED[r.doc_id]
        got = {s.split(":")[0]: int(x) for s, x in zip(r.spans.split(","), r.scores.split(",")) if s}
        assert r.n_spans == len([s for s in r.spans.split(",") if s])
        assert got.get(kind) == score if kind else "iban" not in got, (SCORED[r.doc_id], got)
