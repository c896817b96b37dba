import hashlib
import re

from passlane.llm import secret_scan as S

TEXTS = ["secret=token:abcdefgh", 'é😀password="a1b2c3" x API_KEY: zz9999, AKIA' + "Q" * 16 + " token=" + "deadbeef" * 4,
         "ghp_" + "a" * 40 + " -----BEGIN RSA PRIVATE KEY----- passwd=abc secret = \"abcdef", 'token=="abcdefgh',
         "AKIAAKIA" + "B" * 12 + " apikey:'abc_def'", "0123456789abcdef" * 3000, None, "", "tokentoken=aaaaaa"]


def brute(text):
    out = []
    for order, rule in enumerate(S.RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), order, m.end(), rule.kind))
    return sorted(out)


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def check(frame):
    want = []
    for r in frame.collect():
        spans = brute(r.text)
        base = [s for s in spans if s[1] < len(S.BASE)]
        want.append((r.doc_id, *(sum(s[3] == b.kind for s in base) for b in S.BASE),
                     hashlib.sha256(line(base).encode()).hexdigest(), line(spans)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in S.report(frame).collect())


def test_spans(spark, docs, clashing, no_docs):
    check(spark.createDataFrame(list(enumerate(TEXTS)) + [(0, "x"), (0, "x")], "doc_id long, text string").repartition(3))
    check(docs)
    check(clashing)
    assert S.report(no_docs).count() == 0


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_queries_are_mandatory():
    assert S.trigram_query(r"[0-9a-f]{24,}") is None
    assert S.trigram_query("ab(cd)?e") == [frozenset({"abc", "bcd", "cde"}), frozenset({"abe"})]
    assert S.trigram_query("(?i:Key)x*y|zzz") == [frozenset({"key"}), frozenset({"zzz"})]
    assert S.trigram_query("abc|de") is None
    for rule in S.RULES:
        for text in filter(None, TEXTS):
            for m in re.finditer(rule.pattern, text):
                q = S.trigram_query(rule.pattern)
                assert q is None or any(all(t in m[0].lower() for t in way) for way in q)


def test_only_candidates_are_verified(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {k for r in S.candidates(frame, S.RULES).collect() for k in r.kinds}
    assert {"assign", "access", "github", "pem"} <= found and "hex" not in found and "slack" not in found


def test_masking(spark, clashing, no_docs):
    frame = spark.createDataFrame([(1, TEXTS[1], 5), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in S.mask_secrets(frame).collect()}
    masked = 'é😀[SECRET]" x [SECRET], [SECRET] [SECRET]'
    assert got == {1: (masked, len(masked)), 2: (None, None), 3: ("clean", 5)}
    assert S.mask_secrets(clashing).columns == clashing.columns
    assert S.mask_secrets(clashing).count() == clashing.count() and S.mask_secrets(no_docs).count() == 0
