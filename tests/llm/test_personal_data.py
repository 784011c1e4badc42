"""Personal data: base spans against the patterns run as they stand, further spans by planted cases."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lumaframe.llm.personal_data import digest, find_personal_data, find_spans, luhn, mod97

#: The patterns as stated, for the plain search of the standard library.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(n // 10 + n % 10 for n in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), n, m.end(), k) for n, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text) if right(k, m.group())]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def base(text):
    return [(s.kind, s.start, s.end) for s in find_spans(text) if s.base]


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_are_those_of_the_patterns(seed):
    rng = random.Random(seed)
    pieces = ["a", "B.", "@", "@@", "x@y", ".com", "-", "+", "%", " ", "  ", "1", "12", "0", "255", "256", ".", "..", "4111111111111111", "(", ")", "\n", "é", "한", "😀", "٣", "+49 30 1234567", "1.2.3.4", "000255.1.1.1"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert base(text) == plain(text), text


def test_base_spans_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = digest(find_personal_data(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        written = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in PLAIN]
        left = r.spans.split(",") if r.spans else []
        assert [s for s in left if s in written] == written  # base spans stay, in order


def test_checksums():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432") and mod97("DE89370400440532013000") and not mod97("DE88370400440532013000")


def kinds(text):
    return [(s.kind, text[s.start : s.end]) for s in find_spans(text)]


@pytest.mark.parametrize("text, want", [
    ("pay to DE89 3704 0044 0532 0130 00 now", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("pay to DE88 3704 0044 0532 0130 00 now", []),
    ("IBAN GB82WEST12345698765432.", [("iban", "GB82WEST12345698765432")]),
    ("two 4111111111111111 5500005555555559 run together", [("card", "4111111111111111"), ("card", "5500005555555559")]),
    ("two 4111 1111 1111 1111 5500 0055 5555 5559 in groups", [("card", "4111 1111 1111 1111"), ("card", "5500 0055 5555 5559")]),
    ("+1 (377) 555-0271 4111111111111111 one behind the other", [("phone", "+1 (377) 555-0271"), ("card", "4111111111111111")]),
    ("social security 219-09-9999", [("ssn", "219-09-9999")]),
    ("part no. 219-09-9999", []),
    ("social security 000-09-9999", []),
    ("Call (030) 123 4567 today", [("local_phone", "(030) 123 4567")]),
    ("lines 030 123 4567", []),
    ("version 1.2.3.4", [("ip", "1.2.3.4")]),
    ("plain words, 12 of them; 3.14 and 2024-05-06", []),
])
def test_confirmed_and_scored_spans(text, want):
    assert kinds(text) == want


def test_words_nearby_move_the_score():
    score = lambda text: find_spans(text)[0].score
    assert score("server 10.1.2.3") > score("10.1.2.3") > score("version 10.1.2.3")
    assert score("credit card 4111111111111111") > score("4111111111111111") > score("tracking 4111111111111111")


@pytest.mark.parametrize("piece", ["a", "a.", "1", "1.", "1 ", "+1 (", "@", "a@", "DE89", "(030) 1", "1-", "+", "1.2.3.", "a@b.", "0000 "])
def test_long_runs_take_linear_time(piece):
    began = time.time()
    find_spans(piece * (600_000 // len(piece)))
    assert time.time() - began < 15


def test_odd_rows_and_redaction(spark):
    rows = [(1, None), (2, ""), (3, "é a@b.cc, 1.2.3.4 x"), (3, "é a@b.cc, 1.2.3.4 x"), (None, "😀 a@b.cc"), (4, "x " * 200_000 + "a@b.cc")]
    frame = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, spans string, kind int").repartition(3)
    found = find_personal_data(frame, redact=True)
    assert found.columns == ["doc_id", "text", "kind", "spans"]
    got = sorted(((r.doc_id, r.text, [(s.kind, s.start, s.end, s.base) for s in r.spans]) for r in found.where("doc_id IS NULL OR doc_id < 4").collect()), key=str)
    three = (3, "é <email>, <ip> x", [("email", 2, 8, True), ("ip", 10, 17, True)])
    assert got == sorted([(1, None, []), (2, "", []), three, three, (None, "😀 <email>", [("email", 2, 8, True)])], key=str)
    assert digest(find_personal_data(frame)).where("doc_id = 4").first().spans == "email:400000:400006"
    assert find_personal_data(frame.limit(0)).count() == 0
    assert digest(find_personal_data(frame)).where(F.col("doc_id") == 1).first().base_sha256 == hashlib.sha256(b"").hexdigest()
