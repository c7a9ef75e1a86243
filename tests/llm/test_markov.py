"""The Markov part of the secret scan: a plain-Python ratio, ordinary strings without spans, random ones found."""

import random

import pytest

from marketlens.llm import secrets

ORDINARY = [
    "-" * 40, "_" * 40, "/" * 30, "=" * 35, "2023-01-01-12-00-00-000", "/".join(map(str, range(1, 13))), "https/www-example-com/2024/01/02/some-article-title-here", "IMG_20240102_123456_HDR", "GATTACAGATTACACCGTAGGCTAACGT", "+49-170-1234567-12345",
    "978-3-16-148410-0-1234", "550e8400-e29b-41d4-a716-446655440000", "DE89370400440532013000", "Llanfairpwllgwyngyllgogerychwyrndrobwllllantysiliogogogoch", "MAX_RETRY_COUNT_2024_Q3_FINAL", "SKU-2024-00012345-XL-BLUE", "feature/JIRA-12345-fix-login-page",
    "cpython-313-x86_64-linux-gnu", "abcdefghijklmnopqrstuvwxyz", "Donaudampfschifffahrtselektrizitaetenhauptbetriebswerk", "31415926535897932384", "parseJSONFromHTTPRequestBody", "INC0012345678-REQ000987654",
]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, "ordinary words of some documents without anything particular in them") for i in range(20)], "doc_id long, text string")
    return secrets.train(secrets.labelled_samples(docs))


def plain_ratio(token, model):
    best = run = a = 0
    for c in token:
        b = secrets.LETTERS.find(c) + 1
        run = max(0, run + (model[a * len(secrets.LETTERS) + b - 1] if b else 0))
        best, a = max(best, run), b
    return best


def test_ratio_equals_plain_python(spark, model):
    rng = random.Random(2)
    tokens = [*ORDINARY, "", "é" * 3, *["".join(rng.choice(secrets.LETTERS + " é") for _ in range(rng.randint(1, 60))) for _ in range(40)]]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i long, t string").select("i", secrets.ratio(secrets.F.col("t"), model).alias("r")).collect()
    assert [r.r for r in sorted(got)] == pytest.approx([plain_ratio(t, model) for t in tokens], abs=1e-3)


def test_ordinary_strings_have_no_spans_and_stay(spark, model):
    docs = spark.createDataFrame([(i, f"Title {t} and more.\n{t}\n") for i, t in enumerate(ORDINARY)], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in secrets.scan(docs, model).collect()} == {i: "" for i in range(len(ORDINARY))}
    assert {r.text for r in secrets.redact(docs, model).collect()} == {f"Title {t} and more.\n{t}\n" for t in ORDINARY}


def test_random_strings_are_found(model):
    rng = random.Random(5)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    for letters in (upper + lower + digits + "+/", upper + lower + digits + "-_", upper + lower + digits, upper + "234567"):
        for n in (20, 24, 32, 43):
            found = sum(plain_ratio("".join(rng.choice(letters) for _ in range(n)), model) >= secrets.LEAST_RATIO for _ in range(400))
            assert found >= 0.95 * 400, (letters, n, found)


def test_a_very_long_run_and_text(spark, model):
    rng = random.Random(9)
    secret = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    text = "plain words " * 60_000 + secret + " end " + "-" * 100_000
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert row.spans == f"markov:{12 * 60_000}:{12 * 60_000 + 40}"
