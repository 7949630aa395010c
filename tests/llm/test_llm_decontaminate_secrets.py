"""Wu-Manber search and secret scans against plain rewritings."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import decontaminate, secrets

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = {i: i + 32 for i in range(65, 91)}


def plain_words(text):
    return WORD.findall((text or "").translate(ASCII))


def plain_verdict(text, benchmark):
    words, hit, items = plain_words(text), set(), set()
    for item, passage in benchmark:
        w = plain_words(passage)
        n = min(13, len(w))
        cuts = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in cuts:
                hit.update(range(i, i + n))
                items.add("null" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(words), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(words)


@given(st.lists(st.text("ab ", max_size=6), min_size=1, max_size=6), st.text("ab ", max_size=60))
@settings(max_examples=200, deadline=None)
def test_search_finds_what_comparison_finds(passages, text):
    patterns = {b" " + " ".join(p.split()).encode() + b" " for p in passages if p.split()}
    line = b" " + " ".join(text.split()).encode() + b" "
    groups = decontaminate.compile_windows((p.strip(), "x") for p in patterns)
    got = {(pos, pattern) for g in groups for pos, pattern, _ in g.search(line)}
    assert got == {(i, p) for p in patterns for i in range(len(line)) if line.startswith(p, i)}


@pytest.mark.parametrize("per_block", [1 << 20, 300])
def test_verdicts(spark, per_block):
    rng = random.Random(1)
    vocabulary = ["Alpha", "beta", "çà", "d4", "e"]
    passages = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 13, 20, 30])))) for i in range(12)]
    passages += [(None, "omega omega psi"), (50, None), (51, " ,. "), (3, passages[4][1]), (52, "tau")]
    texts = [None, "", "!!!", "tau", "TAU-tau", "omega, Omega psi", "x" * 100_000, "beta " * 30_000]
    for _ in range(60):
        body = rng.choices(["zeta", "eta", "theta"], k=rng.randrange(60))
        at = rng.randrange(len(body) + 1)
        texts.append(" ".join(body[:at] + (rng.choice(passages[:12])[1]).split() + body[at:]))
    texts += texts[-2:]
    docs = spark.createDataFrame([(i % 60, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_hit int, _items string")
    bench = spark.createDataFrame(passages, "item_id long, text string")
    got = decontaminate.digest(docs, bench, per_block=per_block).collect()
    want = [(i % 60, *plain_verdict(t, passages)) for i, t in enumerate(texts)]
    assert sorted(map(tuple, got)) == sorted(want)
    kept = decontaminate.remove_contaminated(docs, bench, per_block=per_block)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)


def test_many_short_items_are_compiled_in_bounded_blocks(spark):
    """A hundred thousand items of 13 words: no table of a block passes the bound."""
    bench = spark.range(100_000).selectExpr("id AS item_id", "concat_ws(' ', transform(sequence(0, 12), i -> concat('w', hash(id, i)))) AS text")
    pairs = decontaminate.windows(bench, "item_id", "text")
    size = pairs.agg(F.sum("added")).first()[0]
    blocks = -(-size // decontaminate.BYTES_PER_BLOCK)
    assert 8 < blocks < 30
    rows = pairs.where(F.pmod(F.xxhash64("item", "part"), F.lit(blocks)) == 3).collect()
    groups = decontaminate.compile_windows((r.window, r.item) for r in rows)
    assert 1000 < len(rows) and sum(2 * len(g.shift) for g in groups) < 150 << 20


def test_parts_of_a_long_item_are_found(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART", 10)
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([("a", " ".join(words))], "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(words[3:40])), (2, "x " + " ".join(words[47:60])), (3, " ".join(words[:12]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.digest(docs, bench, per_block=60).collect()}
    assert got == {1: (37, 1), 2: (13, 1), 3: (0, 0)}


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.digest(docs, bench).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
    assert decontaminate.digest(docs.limit(0), bench).collect() == []


def plain_spans(text):
    spans = []
    for k, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text or "", re.IGNORECASE | re.ASCII if rule.ignore_case else re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                spans.append((m.start(), k, m.end()))
    return sorted(spans)


SECRETS = [
    None, "", "no secret here", "password=abc", "password=abcdef1", 'API_KEY : "A1b2C3d4E5"', "token:token:abcdef", "apikey=[REMOVED]",
    "é😀 passwd='zzzzzz' tail", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "B" * 20, "f" * 24, "f" * 23, "g" + "0a" * 40 + "g",
    "secret=" + "f" * 30, "ghp_" + "a" * 36, "xoxb-1234567890", "-----BEGIN RSA PRIVATE KEY-----", "https://me:pw@host/", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12,
    "😀" * 5000 + " secret: abcdefg " + "9" * 50, "Passwd=ÀÀ token==abcdef", "password=abcdef " * 300, "PASSWORD =abcdef", "toKen=abcdef", "K" * 10 + "toKen=abcdef",
]


def test_spans(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(SECRETS)], "doc_id long, text string, spans string")
    for row in secrets.digest(docs).collect():
        spans = plain_spans(SECRETS[row.doc_id])
        name = lambda chosen: ",".join(f"{secrets.RULES[k].kind}:{s}:{e}" for s, k, e in chosen)
        assert row.spans == name(spans), SECRETS[row.doc_id]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert row.base_sha256 == hashlib.sha256(name([x for x in spans if x[1] < 3]).encode()).hexdigest()


def test_redaction_leaves_no_span(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(SECRETS)], "doc_id long, text string, _spans string")
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    for row in clean.collect():
        before = SECRETS[row.doc_id]
        assert plain_spans(row.text) == [] and (row.text is None) == (before is None)
        if not plain_spans(before):
            assert row.text == before
    assert secrets.digest(docs.limit(0)).collect() == []


def test_redaction_beside_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "password = hunter22", "a", "b", "c")], "doc_id long, text string, _postings_l string, _lower string, _POSTINGS string")
    assert secrets.redact(docs).collect() == [(1, "[REMOVED]", "a", "b", "c")]


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_every_match_satisfies_its_query(rule):
    for text in SECRETS:
        for m in re.finditer(rule.pattern, text or "", re.IGNORECASE if rule.ignore_case else 0):
            for clause in secrets.trigram_query(rule.pattern):
                assert any(all(g in m.group().lower() for g in string) for string in clause)
    assert bool(secrets.trigram_query(rule.pattern)) == (rule.kind != "hex")


def test_main_path_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = secrets.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
