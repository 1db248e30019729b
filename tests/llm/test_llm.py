"""Every operator of the subpackage against brute force, on a table with the awkward rows."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from folioloom.llm import chat, components, decontaminate, encode, lm, mixing, quality, rules, simhash, tokencount, tokenfiles, warc
from folioloom.llm.store import Workspace

DOCS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()),
    StructField("n_chars", LongType()), StructField("fp", StringType()), StructField("id", StringType()), StructField("n_words", StringType()),
])


def prose(rng, n, vocabulary=None):
    vocabulary = vocabulary or ["the", "of", "er", "Thion", "and,", "léa.", "ñoz", "reha", "onti", "stent", "ble.", "was"]
    return " ".join(rng.choice(vocabulary) + (rng.choice("abcdef") if rng.random() < 0.3 else "") for _ in range(n))


def rows():
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    texts += [None, "", " \n\t ", "one", "two words", texts[0], texts[0], texts[1] + " extra", prose(rng, 30_000)]
    texts += ["<|endoftext|> special<|startoftext|>", "İstanbul ΣΑΣ 中文 字 \x00 é", "wide  spaces \n\n lines\r\nend ", "A!! B!! C!! " * 40, "x | y | z\n" * 30]
    out = [(k, t, "en", f"src{k % 3}" if k % 7 else None, None, "clash", "clash", None) for k, t in enumerate(texts)]
    out += [out[2], out[2], (None, texts[3], None, "src1", 1, None, None, "x"), (None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 2 ---------------------------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    w = words_of(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if words_of(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rules_measures_match_brute_force():
    for r in rows():
        assert rules.measure((r[1] or "").encode())[:5] == brute_measures(r[1])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té|#　", max_size=60))
def test_rules_measures_property(text):
    assert rules.measure(text.encode())[:5] == brute_measures(text)


def test_rules_ledger_filter_and_ablation(docs, empty):
    book = rules.ledger(docs).cache()
    assert book.count() == docs.count()
    kept = book.where(rules.passes("standard-v1")).count()
    filtered = rules.filter_documents(docs)
    assert filtered.columns == docs.columns and filtered.count() == kept > 0
    for r in rules.ablation(book).collect():
        bit = 1 << next(x.bit for x in rules.RULES if x.name == r.rule)
        masks = [x.failed for x in book.collect()]
        assert (r.n_failed, r.n_only) == (sum(bool(m & bit) for m in masks), sum(m == bit for m in masks))
        assert r.n_kept_without == sum(not m & ~bit for m in masks)
    assert rules.ledger(empty).count() == 0 and rules.filter_documents(empty).count() == 0


# --- 1 and 7 ---------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAB éÉ.,'!12½\n\t　<|>endoftxİß中́", max_size=40))
def test_encoders_equal_the_library(text):
    for vocab in (tokenfiles.VOCAB, tokencount.VOCAB):
        e = encode.encoder(vocab)
        want = e.tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == want
        assert e.count(text) == len(want)


def test_token_counts(docs, empty):
    e = encode.encoder(tokencount.VOCAB)
    got = sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(docs).collect())))
    want = [(r[0], len((r[1] or "").encode()), len(e.tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows()]
    assert got == sorted(map(repr, want))
    assert tokencount.count_tokens(empty).count() == 0


def test_token_files_round_trip(spark, docs, empty):
    e = encode.encoder(tokenfiles.VOCAB)
    manifest = tokenfiles.write_tokens(docs, Workspace(spark, "t").path("f"))
    got = sorted(tokenfiles.read_tokens(manifest).collect(), key=lambda r: r.start)
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for r, d in zip(got, ordered, strict=True):
        ids = [*e.tok.encode(d[1] or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.tokens) == (d[0], start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert tokenfiles.token_digest(spark, empty).count() == 0


# --- 3 ---------------------------------------------------------------------------------------


def test_warc(spark):
    big = "<p>" + "x" * 200
    inner = warc.record(9, "http://a", b"y" * 150, "d").decode()
    table = [(3, "http://a/\r\nWARC: x", big), (1, None, big), (2, "u", big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", "n" * 120), (7, "u", "before " + inner + inner), (8, "é", "WARC/1.1\r\n" * 50), (8, "é", "")]
    pages = spark.createDataFrame(table, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("d", F.lit(2))
    files = warc.write_warc(pages, Workspace(spark, "t").path("w"), file_bytes=1500)
    assert files.count() > 1
    got = warc.read_warc(files).collect()
    assert len(got) == len(table) and all(r.intact for r in got)
    kinds = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in got if r.page_id not in (8, None)}
    assert kinds[1] == ("response", None, 203) and kinds[2] == ("revisit", 1, 203) and kinds[3] == ("revisit", 1, 203)
    assert kinds[4][0] == kinds[5][0] == "response" and kinds[6] == ("response", None, 0)
    assert warc.candidates(files).count() > len(table)  # false starts are seen, and dropped by the chain
    assert warc.read_warc(warc.write_warc(pages.where("page_id > 99"), Workspace(spark, "t").path("w"))).count() == 0


def test_warc_keeps_long_urls_and_headers(spark):
    long = "http://a/" + "x" * 200_000
    table = [(1, long, "short"), (2, long + "y", "WARC/1.1\r\n" * 30_000), (None, "u", "n" * 150), (3, "u", "n" * 150), (4, None, "n" * 150)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string")
    files = warc.write_warc(pages.coalesce(1), Workspace(spark, "t").path("w"))
    got = {r.page_id: r for r in warc.read_warc(files).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 2: ("response", None), None: ("response", None), 3: ("response", None), 4: ("revisit", 3)}
    heads = {}
    for f in files.collect():
        data = bytes(warc.map_range(f.path, 0, f.n_bytes))
        at = 0
        while at < len(data):
            r = warc.parse_record(data, at)
            heads[r["fields"][b"warc-record-id"]], at = r["fields"].get(b"warc-target-uri"), r["next"]
    assert heads[b"<urn:page:1>"] == long.encode() and heads[b"<urn:page:2>"] == long.encode() + b"y"
    with pytest.raises(ValueError, match="chain"):
        warc.read_warc(files.withColumn("n_records", F.col("n_records") + 1))


def test_warc_records_that_the_data_cut_off():
    whole = warc.record(5, "http://a/b", b"<p>payload</p>", "d")
    for k in range(len(warc.MAGIC), len(whole)):
        with pytest.raises(warc.CutOff):
            warc.parse_record(whole[:k], 0)
    assert warc.parse_record(whole, 0)["next"] == len(whole)
    assert warc.parse_record(warc.MAGIC + b"no header\r\n\r\n", 0) is None


def test_warc_against_sql_with_null_and_repeated_ids(spark):
    import duckdb

    rows_ = [(None, "u", "z" * 120), (5, "u", "z" * 120), (5, "v", "z" * 120), (7, None, "z" * 120), (None, "u", "q" * 120), (None, "u", "q" * 120), (8, "u", None), (9, "u", "")]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string")  # noqa: F841 - the SQL names it
    got = warc.read_warc(warc.write_warc(pages, Workspace(spark, "t").path("w")))
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows_)
    want = con.execute(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({warc.OP3_SQL})").fetchall()
    assert Counter(map(repr, want)) == Counter(repr(tuple(r)) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_reachable_drops_false_starts():
    at, nxt = np.array([0, 5, 10, 12, 20]), np.array([10, 12, 20, 20, 33])
    assert warc.reachable(at, nxt).tolist() == [True, False, True, False, True]
    assert warc.reachable(at[1:], nxt[1:]).tolist() == [False] * 4


# --- 4 ---------------------------------------------------------------------------------------


def test_mixing_meets_its_targets(spark, empty):
    rng = random.Random(1)
    table = [(k, "big" if k % 10 < 6 else f"s{k % 10}" if k % 10 < 9 else None, prose(rng, rng.randint(0, 40))) for k in range(3000)]
    docs = spark.createDataFrame(table, "doc_id long, source string, text string")
    tok = encode.encoder(mixing.VOCAB).tok
    n = {k: len(tok.encode(t, add_special_tokens=False).ids) for k, _, t in table}
    one = max(n.values())
    totals = Counter()
    for k, s, _ in table:
        totals[s] += n[k]
    everything = sum(totals.values())

    got = mixing.mixed(docs, mixing.Mix(max_repeats=1.5)).collect()
    taken, copies = Counter(), Counter()
    for r in got:
        taken[r.source] += n[r.doc_id]
        copies[r.doc_id] += 1
    assert set(copies) == set(n)
    p = {s: t / everything for s, t in totals.items()}
    low, high = 0.0, 1.0
    for _ in range(60):  # the plain bisection
        a = (low + high) / 2
        low, high = (low, a) if max(x ** (a - 1) for x in p.values()) / min(x ** (a - 1) for x in p.values()) <= 1.5 else (a, high)
    for s in p:
        want = p[s] ** (high - 1) / min(x ** (high - 1) for x in p.values()) * totals[s]
        assert abs(taken[s] - want) <= one

    ranks, blocks = {}, {}
    for r in got:
        assert ranks.setdefault((r.source, r["__epoch"], r["__rank"]), r["__block"]) == r["__block"]
        blocks.setdefault((r.source, r["__epoch"]), set()).add(r["__block"])
    for (source, epoch), found in blocks.items():
        order = [ranks[source, epoch, k] for k in range(1, len(found) + 1)]  # each epoch is a permutation of its blocks
        assert set(order) == found and len(order) == len(found)
        if epoch == 2:  # not that of the first epoch
            assert order != [ranks[source, 1, k] for k in range(1, len(found) + 1)]

    budget = everything // 2
    got = mixing.mixed(docs, mixing.Mix(entropy=0.95, max_repeats=4, budget=budget)).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += n[r.doc_id]
    share = [v / sum(taken.values()) for v in taken.values()]
    assert abs(-sum(x * math.log(x) for x in share) / math.log(len(p)) - 0.95) < 0.01
    assert abs(sum(taken.values()) - budget) <= one * len(p)
    assert mixing.mixed(empty).count() == 0


def test_mixing_keeps_columns_and_rows(docs):
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "__epoch", "__block", "__rank", "__place"]
    assert out.where("__epoch = 1").count() == docs.count()


def test_mixing_with_clashing_names_and_many_epochs(spark):
    names = ["src", "h", "b", "p", "cut", "key"]
    rows_ = [(k, "s" if k else None, None if k % 50 == 3 else "word " * (k % 7 + 1), *[k] * 6) for k in range(400)] + [(400, "t", "one two three " * 9000, *[0] * 6)]
    table = spark.createDataFrame(rows_, "doc_id long, source string, text string, " + ", ".join(f"{c} long" for c in names))
    got = mixing.mixed(table, mixing.Mix(entropy=0.9, max_repeats=1e9, budget=90_000)).collect()
    assert {r.doc_id for r in got if r.source == "s"} == set(range(1, 400)) and all(r.h == r.p for r in got)
    epochs = Counter(r["__epoch"] for r in got if r.source == "s")
    assert len(epochs) > 3 and all(n == 399 for e, n in epochs.items() if e < max(epochs))


def test_block_count_grows_with_the_table():
    assert [mixing.block_count(n) for n in (0, 1000, 1 << 20, 1 << 40)] == [64, 64, 1 << 11, 1 << 21]


# --- 5 ---------------------------------------------------------------------------------------


def test_quality_votes(spark, empty):
    rng = random.Random(2)
    good = [prose(rng, 60) for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 60).split()) for _ in range(100)]
    docs = spark.createDataFrame([*enumerate(good + bad), (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(0, 400, 2)] + [(None, 1), (3, None), (5000, 1)], "doc_id long, quality int")
    x, y = quality._sampled(docs, labels, F.lit(True), 4096)
    assert len(y) == 200
    model = spark.sparkContext.broadcast(quality.fit(x, y))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert all(got[k] > 0.5 for k in range(1, 300, 2)) and all(got[k] < 0.5 for k in range(301, 400, 2))
    none = quality.fit(*quality._sampled(docs, labels.where("false"), F.lit(True), 10))
    assert {r.score for r in quality.score(docs, spark.sparkContext.broadcast(none)).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_quality_query_against_direct_computation(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = {r.doc_id: r for r in quality.op5_quality(spark, sf).collect()}
    features = {r.doc_id: np.bincount(quality._tokens((r.text or "").encode())[0], minlength=quality._SIZE).astype(np.float32) for r in docs}
    inside = [r.doc_id for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in labels]
    model = quality.fit(np.stack([features[k] for k in inside]), np.array([float(labels[k] > 0) for k in inside], np.float32))
    want = quality.vote(model, quality._unit(np.stack([features[r.doc_id] for r in docs]) @ model["map"]))
    assert len(out) == len(docs) and all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for k, r in out.items())
    assert np.mean([abs(out[r.doc_id].score - s) < 1e-3 for r, s in zip(docs, want, strict=True)]) > 0.99
    held = [(out[k].score, y) for k, y in labels.items() if k in out and out[k].held_out]
    good, bad = [v for v, y in held if y], [v for v, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_quality_of_long_words_and_texts():
    assert quality._shape("aB3$" * 1000) == "aA0$" * 1000 and quality._shape("a" * 10_000) == "a"
    f, n = quality._tokens(b"word " * 300_000)
    assert n == 300_000 and len(f) == 2 * n + n - 1 + 1


def test_vote_equals_brute_force():
    rng = np.random.default_rng(0)
    unit = quality._unit(rng.normal(size=(500, 8)))
    model = {"vectors": unit[:300].astype(np.float32), "labels": rng.integers(0, 2, 300).astype(float)}
    got = quality.vote(model, unit[300:].astype(np.float32), block=7)
    for v, s in zip(unit[300:], got, strict=True):
        cos = unit[:300] @ v
        near = np.argsort(-cos)[: quality.NEIGHBOURS]
        w = np.maximum(cos[near], 1e-6) ** quality.SHARPNESS
        assert abs(s - (w * model["labels"][near]).sum() / w.sum()) < 1e-3


# --- 6 ---------------------------------------------------------------------------------------


def test_preference_turns(spark):
    table = [
        (0, True, 10, 0, "user", "hi"), (0, True, 10, 1, "assistant", "yes"), (0, True, 10, 1, "assistant", "yes"), (0, False, 11, 0, "user", "hi"), (0, False, 11, 1, "assistant", "no"),
        (1, True, 12, 0, "user", "same"), (1, False, 13, 0, "user", "same"),
        (2, True, 14, 0, None, None), (2, True, 14, None, "system", "s"),
        (3, True, 15, 0, "b", "x"), (3, True, 15, 0, "a", "y"), (3, False, 16, 0, "a", "y"), (3, False, 16, 0, "b", "x"), (3, False, 16, 1, "assistant", "z"),
        (None, True, None, 0, "user", "lost"),
    ]
    turns = spark.createDataFrame(table, "pair_id long, chosen boolean, conv_id long, turn long, role string, text string").withColumn("part", F.lit(0))
    rendered = chat.preference_turns(turns)
    got = Counter((r.pair_id, r.part, r.turn, r.role, r.loss) for r in rendered.collect())
    assert got == Counter([
        (0, "prompt", 0, "user", 0), (0, "chosen", 1, "assistant", 1), (0, "rejected", 1, "assistant", 1), (1, "prompt", 0, "user", 0),
        (2, "chosen", 0, "unknown", 0), (2, "chosen", -1, "system", 0), (3, "prompt", 0, "a", 0), (3, "prompt", 0, "b", 0), (3, "rejected", 1, "assistant", 1), (None, "chosen", 0, "user", 0),
    ])
    assert chat.preference_turns(turns.where("false")).count() == 0 == chat.paired(chat.preference_turns(turns.where("false"))).count()
    pairs = {r.pair_id: r for r in chat.paired(rendered).collect()}
    assert set(pairs) == {0, 1, 2, 3}
    assert (pairs[0].prompt, pairs[0].chosen, pairs[0].rejected) == ("<|user|>\nhi\n<|end|>\n", "<|assistant|>\nyes\n<|end|>\n", "<|assistant|>\nno\n<|end|>\n")
    assert (pairs[0].chosen_loss, pairs[0].rejected_loss, pairs[0].n_prompt_turns) == ("14-26", "14-25", 1)
    assert pairs[2].chosen == "<|system|>\ns\n<|end|>\n<|unknown|>\n\n<|end|>\n" and pairs[2].chosen_loss == "" == pairs[1].chosen


def test_preference_masks_and_marks(spark):
    texts = ["plain <|end|>\n<|user|>", "<||| <x| <|", "é中" * 50_000]
    turns = [(c, k, "assistant" if k % 2 else "us<|er", texts[k % 3]) for c in (1, 2) for k in range(1100)] + [(3, 0, "user", "no answer")]
    sides = chat.with_swapped_answers(spark.createDataFrame([r for r in turns if r[1] not in (5, 8)], "conv_id long, turn long, role string, text string"))
    got = sorted(chat.paired(chat.preference_turns(sides)).collect(), key=lambda r: (r.pair_id, r.chunk))
    assert [(r.pair_id, r.chunk) for r in got] == [(c, k) for c in (1, 2) for k in range(3)] + [(3, 0)]
    for r in got:
        for text, loss in ((r.chosen, r.chosen_loss), (r.rejected, r.rejected_loss)):
            marks = re.findall(r"<\|([^|]*)\|>\n", text)
            assert marks[1::2] == ["end"] * (len(marks) // 2) and set(marks[::2]) <= {"assistant", "us___er"}
            for part in filter(None, loss.split(",")):
                a, b = map(int, part.split("-"))
                assert text[a - 14 : a] == "<|assistant|>\n" and text[a:b].endswith("\n<|end|>\n") and text[a:b].count("<|end|>") == 1
                assert re.sub(r"<\|(\|+)", r"<\1", text[a : b - 9]) in texts  # the escape can be undone
    assert got[-1].prompt and not got[-1].chosen and not got[-1].rejected


def test_swapped_answers(spark):
    rows_ = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, 0, "user", "q2"), (2, 1, "assistant", "b"), (2, 2, "user", "bye"), (70, 0, "assistant", None), (None, 0, "assistant", "x"), (4, 0, "user", "alone")]
    got = Counter(tuple(r) for r in chat.with_swapped_answers(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")).select("pair_id", "chosen", "turn", "text").collect())
    assert got == Counter([(1, True, 0, "q"), (1, True, 1, "a"), (2, True, 0, "q2"), (2, True, 1, "b"), (2, True, 2, "bye"), (70, True, 0, ""), (4, True, 0, "alone"),
                           (1, False, 0, "q"), (1, False, 1, "b"), (2, False, 0, "q2"), (2, False, 1, "a"), (2, False, 2, "bye"), (70, False, 0, ""), (4, False, 0, "alone")])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_preference_query_reaches_prompt_and_masks(spark, sf):
    got = chat.op6_preference(spark, f"/root/testdata/{sf}").collect()
    assert sum(r.n_prompt_turns for r in got) > 0 and any(r.chosen_loss and r.rejected_loss for r in got)
    assert len(got) == spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id").distinct().count()


# --- 8 ---------------------------------------------------------------------------------------


def test_language_model(spark, docs, empty):
    space = Workspace(spark, "t")
    train = docs.where("doc_id % 4 <> 0").select("text")
    counts, vocabulary, model = lm.learn(train, space)
    c = Counter()
    for r in rows():
        if r[0] is not None and r[0] % 4:
            c.update(w.encode().lower() for w in words_of(r[1]))
            c["end"] += 1
    n, v = sum(c.values()), len(c)
    assert (vocabulary.value.tokens, vocabulary.value.types) == (n, v)
    got = Counter(repr((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5))) for r in lm.score(docs, counts, vocabulary, model, space).collect())
    want = Counter()
    for r in rows():
        t = [*(w.encode().lower() for w in words_of(r[1])), "end"]
        want[repr((r[0], len(t), sum(c[x] > 0 for x in t), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 5)))] += 1
    assert got == want
    assert lm.score(empty, counts, vocabulary, model, space).count() == 0
    total, log_of = brute_model(c, vocabulary.value, model.value)
    assert all(abs(total(one, two) - 1) < 1e-5 for one, two in ((lm.START, lm.START), (0, lm.START), (1, 2)))
    want = Counter(round(log_of([*(w.encode().lower() for w in words_of(r[1])), "end"]), 1) for r in rows() if len(r[1] or "") < 1000)
    got = [r.score for r in lm.score(docs.where("text is null or length(text) < 1000"), counts, vocabulary, model, space).collect()]
    assert len(got) == sum(want.values()) and np.allclose(sorted(got), sorted(want.elements()), atol=0.06)


def brute_model(c, vocabulary, p):
    """What the model's words sum to in a context, and the log of a text, from the parameters alone."""

    def class_of(w):
        if w == "end":
            return lm.END
        if w in vocabulary.words[: vocabulary.shortlist]:
            return lm.FIRST_WORD + vocabulary.words.index(w)
        return vocabulary.endings.get(w.decode()[-2:], lm.OTHER)

    members = {}
    for w in c:
        members.setdefault(class_of(w), []).append(w)

    def classes(one, two):
        x = ((p["context"][one] * p["place"][0] + p["context"][two] * p["place"][1]) @ p["target"].T + p["bias"]).astype(float)
        e = np.exp(x - x.max())
        return e / e.sum()

    def share(w, k):
        if lm.END <= k < lm.FIRST_WORD + vocabulary.shortlist:
            return 1.0
        return (c[w] + 1) / (sum(c[m] for m in members.get(k, [])) + len(members.get(k, [])) + 1)

    def total(one, two):
        probability = classes(one, two)
        single = range(lm.END, lm.FIRST_WORD + vocabulary.shortlist)
        return sum(probability[k] * (sum(share(w, k) for w in members.get(k, [])) + (0 if k in single else share(b"never seen", k))) for k in range(len(probability)))

    def log_of(words):
        one = two = lm.START
        out = 0.0
        for w in words:
            k = class_of(w)
            out += math.log10(classes(one, two)[k] * share(w, k))
            one, two = vocabulary.contexts[k], one
        return out

    return total, log_of


def test_language_model_does_not_depend_on_splits(spark, docs):
    got = []
    for n in (1, 5):
        space = Workspace(spark, "t")
        learned = lm.learn(docs.repartition(n).select("text"), space)
        got.append(sorted(r.score for r in lm.score(docs, *learned, space).collect()))
    assert np.allclose(*got, rtol=1e-4)


def test_language_model_gains_on_held_out_documents(spark):
    r = lm.op8_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert (r.s - r.b) / r.n > 0.3


def test_tables_are_normalised():
    noise = np.full(40, 1 / 40)
    trainer = lm.Trainer(noise, 0)
    rng = np.random.default_rng(0)
    for _ in range(300):
        one = rng.integers(0, 40, 256)
        trainer.step((one * 7 + 3) % 40, one, rng.integers(0, 41, 256))
    near, far, z = lm.tables(trainer.p)
    for a, b in ((0, 0), (3, 40), (39, 40)):
        p = np.exp(near[a] + far[b] - z[a, b])
        assert abs(p.sum() - 1) < 1e-3
        assert p.argmax() == (a * 7 + 3) % 40  # it has learnt the rule
    direct = np.log(np.exp(near[5] + far[6]).sum())
    assert abs(direct - z[5, 6]) < 1e-3
    sharp = {k: v.copy() for k, v in trainer.p.items()}
    sharp["target"] = np.eye(40, lm.DIMENSIONS, dtype=np.float32)
    sharp["context"][:2] = 400 * sharp["target"][:2]
    near, far, z = lm.tables(sharp)
    both = (near[0] + far[1]).astype(float)
    assert abs(both.max() + np.log(np.exp(both - both.max()).sum()) - z[0, 1]) < 1e-3


def test_language_model_with_nothing_to_learn(spark, docs):
    space = Workspace(spark, "t")
    counts, vocabulary, model = lm.learn(docs.where("false").select("text"), space)
    got = lm.score(docs, counts, vocabulary, model, space).collect()
    assert len(got) == docs.count() and all(r.base_score == 0 and r.n_known == 0 for r in got)


def test_head_is_joined_exactly_when_it_is_small(spark, docs, monkeypatch):
    space = Workspace(spark, "t")
    full = lm.learn(docs.select("text"), space)
    want = {repr((r.doc_id, r.n_known, round(r.base_score, 4))) for r in lm.score(docs, *full, space).collect()}
    monkeypatch.setattr(lm.head_of, "__defaults__", (5,))
    space = Workspace(spark, "t")
    small = lm.learn(docs.select("text"), space)
    assert len(small[1].value.words) <= 5
    assert {repr((r.doc_id, r.n_known, round(r.base_score, 4))) for r in lm.score(docs, *small, space).collect()} == want


# --- 9 ---------------------------------------------------------------------------------------


def test_masks_hit_every_window_with_two_substitutions():
    w = decontaminate.WINDOW
    for a in range(w):
        for b in range(a, w):
            assert any(all(m[k] == "0" or o + k not in (a, b) for k in range(len(m))) for m in decontaminate.MASKS for o in range(w - len(m) + 1))


def test_decontamination_against_brute_force(spark, empty):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [prose(rng, n, vocabulary).split() for n in (40, 25, 13, 9, 6, 3, 40, 1, 2, 4, 12)]
    table, want = [], set()
    for k in range(160):
        item = k % len(items)
        words = prose(rng, 80, vocabulary).split()
        part = list(items[item])
        kind = k // len(items) % 4
        for j in rng.sample(range(len(part)), min(len(part), (0, 2, 5, 0)[kind])):
            part[j] = "changed"
        if kind != 3:
            words[30:30] = [x.upper() + "," if rng.random() < 0.2 else x for x in part]
        table.append((k, " ".join(words)))
    table += [(500, None), (501, ""), (None, " ".join(items[0]))]
    bench = [(k, " ".join(x)) for k, x in enumerate(items)] + [(70, " ".join(items[0]).upper()), (71, None), (72, "")]

    def bare(t):
        return [x.strip(decontaminate._ENDS).lower() for x in words_of(t)]

    for d, t in table:
        dw = bare(t)
        for k, item in enumerate(items):
            iw = bare(" ".join(item))
            w = min(13, len(iw))
            best = max((sum(dw[p + q + j] == iw[q + j] for j in range(w)) for q in range(len(iw) - w + 1) for p in range(-q, len(dw) - w - q + 1) if p + q >= 0), default=0)
            if best >= 0.8 * w:
                want.add((d, k))
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("hash", F.lit("x"))
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.contaminated(docs, benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got == want and all(r.n_equal >= 0.8 * r.n_compared for r in found)
    assert {r.n_items for r in found if r.item_id == 0} == {2}
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in table} - {d for d, _ in got}
    clash = docs.union(spark.createDataFrame([(0, "clean text", 1, "x"), (None, "clean text", 1, "x")], docs.schema))
    assert decontaminate.drop_contaminated(clash, benchmark).where("text = 'clean text'").count() == 2
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("false")).count() == 0


def test_short_masks_hit_every_substitution_that_the_share_allows():
    for n in range(1, decontaminate.WINDOW):
        for places in combinations(range(n), n - math.ceil(0.8 * n)):
            assert any(all(m[k] == "0" or o + k not in places for k in range(len(m))) for m in decontaminate._patterns(n) for o in range(n - len(m) + 1)), (n, places)


def test_items_of_every_length_are_found_with_substitutions(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(400)]
    items = {n: [f"i{n}.{k}" for k in range(n)] for n in range(1, 41)}
    table, want = [], set()
    for n, item in items.items():
        allowed = n - math.ceil(0.8 * n)
        for size in (0, allowed, allowed + 1) if n < 13 else (0, 2):
            for places in combinations(range(n), size) if n < 14 else [rng.sample(range(n), size)]:
                part = [f"x{rng.random()}" if k in places else w for k, w in enumerate(item)]
                if size <= allowed or n >= 13:
                    want.add((len(table), n))
                table.append((len(table), " ".join([*(f"y{rng.random()}" for _ in range(20)), *part, *(f"z{rng.random()}" for _ in range(20))])))
    found = decontaminate.contaminated(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_repetitive_texts_meet_once(spark):
    docs = spark.createDataFrame([(1, "a b " * 9000), (2, "c")], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(1, "a b " * 100), (2, "b a " * 3), (3, "c")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_equal, r.doc_pos) for r in found} == {(1, 1, 13, 0), (1, 2, 6, 1), (2, 3, 1, 0)}


# --- 10 --------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(table):
    parent = list(range(len(table)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(table)):
        for j in range(i):
            if (table[i][1] ^ table[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(table):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, f"{fp:016x}", low.get(find(i))) for i, (d, fp) in enumerate(table))


def test_simhash_documents(spark, docs, empty):
    got = Counter((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.components(docs).collect())
    assert got == brute_components([(r[0], brute_fingerprint(r[1])) for r in rows()])
    kept = simhash.keep_one(docs).collect()
    tops = {k[2] for k in got if k[0] is not None}
    assert Counter(r.doc_id for r in kept) == Counter(tops)
    rows_of = {(r[0], r[1]): r for r in rows()}
    assert all(tuple(r) == rows_of[r.doc_id, r.text] for r in kept)
    clash = [(5, "one text of its own"), (5, "and quite another one"), (5, "and quite another one"), (6, "one text of its own"), (None, "nobody's text"), (None, "nobody's text"), (None, "one text of its own")]
    kept = simhash.keep_one(spark.createDataFrame(clash, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter({(5, clash[0][1]): 1, (5, clash[1][1]): 1, (None, "nobody's text"): 1})
    assert simhash.components(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_finer_grids_hold_every_close_pair():
    grids = simhash._grids()
    assert len(grids) == 10 and {len(inner) for _, inner in grids} == {10}
    for mask, inner in grids:
        free = [k for k in range(32) if not mask >> 2 * k & 1]
        for a, b in combinations(free, 2):  # wherever two coordinates differ, a finer grid ignores both
            assert any(not m >> 2 * a & 1 and not m >> 2 * b & 1 for m in inner)
        assert all(m & mask == mask and (m & 0x5555555555555555).bit_count() >= 26 for m in inner)


@pytest.mark.parametrize("cell_most", [2, 16, 64])
def test_simhash_links_near_fingerprints_and_crowds(spark, cell_most):
    rng = random.Random(7)
    table = []
    for group in range(12):
        base = rng.getrandbits(64)
        for _ in range(90 if group < 3 else 4):
            table.append(base)
            base ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3))))
    table = list(dict.fromkeys(table))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in table]
    space = Workspace(spark, "t")
    found = simhash.links(spark.createDataFrame(signed, "fp long"), space, cell_most)
    label = {r.node: r.label for r in components.connected_components(found, space).collect()}
    groups = {}
    for (fp,) in signed:
        groups.setdefault(label.get(fp, fp), set()).add(fp)
    want = {}
    for (d, _, top) in brute_components([(s[0], x) for s, x in zip(signed, table, strict=True)]):
        want.setdefault(top, set()).add(d)
    assert set(map(frozenset, groups.values())) == set(map(frozenset, want.values()))


@pytest.mark.parametrize("cell_most", [2, 16])
def test_near_copies_share_a_component(spark, cell_most):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(900)]
    table = []
    for size in (3, 2, 40, 5, 4, 2):
        base = prose(rng, 200, vocabulary).split()
        for k in range(size):
            copy = list(base)
            for j in rng.sample(range(200), min(k, 3)):
                copy[j] = f"new{rng.random()}"
            table.append((len(table), " ".join(copy)))
    table += [(len(table), None), (len(table) + 1, table[0][1].upper()), (len(table) + 2, prose(rng, 200, vocabulary))]
    sets = {k: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for k, t in table for w in [(t or "").lower().split()]}
    top = {k: k for k in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    docs = spark.createDataFrame(table, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.components(docs, cell_most=cell_most, jaccard=0.8, near_cell_most=cell_most).collect()} == top
    assert {r.doc_id for r in simhash.keep_one(docs, jaccard=0.8).collect()} == set(top.values())


def crowd_of_twins():
    """Variants of one text, hardly less similar than 0.8, and a near copy of each; most of them share bands."""
    rng = random.Random(12)
    table = []
    for k in range(100):
        variant = [f"w{j}" for j in range(400)]
        for j in rng.sample(range(400), 6):
            variant[j] = f"v{k}x{j}"
        twin = list(variant)
        for j in rng.sample(range(400), 8):
            twin[j] = f"t{k}x{j}"
        table += [(2 * k, " ".join(variant)), (2 * k + 1, " ".join(twin))]
    return table


def test_crowded_cells_lose_no_near_copy(spark):
    table = crowd_of_twins()
    sets = {k: simhash.shingle_set(t.encode()) for k, t in table}
    bands = {k: set(enumerate(simhash.band_keys(s).tolist())) for k, s in sets.items()}
    close = [(a, b) for a, b in combinations(sets, 2) for both in [len(np.intersect1d(sets[a], sets[b]))] if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)]
    assert all(bands[a] & bands[b] for a, b in close) and max(Counter(x for s in bands.values() for x in s).values()) > simhash.NEAR_CELL_MOST
    docs = spark.createDataFrame(table, "doc_id long, text string")
    tops = brute_near(dict(table), 0.8)
    assert len(set(tops.values())) > 20
    assert {r.doc_id: r.component_id for r in simhash.components(docs, jaccard=0.8).collect()} == tops


@pytest.mark.parametrize("block", [7, 512])
def test_blocks_admit_what_pairs_admit(spark, block):
    texts = dict(crowd_of_twins()[:60] + [(100 + k, " ".join(f"z{j}" for j in range(k, 2 * k + 80))) for k in range(0, 1200, 40)])
    sets = {k: simhash.shingle_set(t.encode()) for k, t in texts.items()}
    about = spark.createDataFrame([(k, len(s), simhash.parity(s)) for k, s in sets.items()], "sig long, n long, parity binary")
    labels = {k: k // 4 for k in sets if k % 3}
    name = {k: labels.get(k, k) for k in sets}
    crowd = [(k, key) for key in (5, 6, 7) for k in sets if k % key]
    want = set()
    for (a, x), (b, y) in combinations(sorted(crowd), 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        apart = simhash.least_difference(simhash.parity(sets[a]), simhash.parity(sets[b]))
        if x == y and name[a] != name[b] and small >= 0.8 * large and apart * 1.8 <= (small + large) * 0.2 + 1e-6:
            want.add((a, b))
    named = spark.createDataFrame(list(labels.items()), "node long, label long")
    crowd = spark.createDataFrame(crowd, "sig long, key long")
    got = lambda first: {tuple(r) for r in simhash._admitted(crowd, named, about, 0.8, block, first).collect()}
    assert got(False) == want and (got(True) < want if block > len(sets) else got(True) <= want)


def test_components_of_a_long_chain(spark):
    pairs = [(k * 17 % 1000, (k + 1) * 17 % 1000) for k in range(999)] + [(5000, 5001), (7, 7)]
    got = components.connected_components(spark.createDataFrame(pairs, "a long, b long"), Workspace(spark, "t")).collect()
    assert len(got) == 1002 and {(r.node >= 5000, r.label) for r in got} == {(False, 0), (True, 5000)}


# --- pipeline --------------------------------------------------------------------------------


def brute_near(texts, jaccard):
    """Smallest id that SimHash links and similar sets of 5-word shingles reach."""
    prints = {k: brute_fingerprint(t) for k, t in texts.items()}
    sets = {k: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for k, t in texts.items() for w in [(t or "").lower().split()]}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        near = (prints[a] ^ prints[b]).bit_count() <= 2
        small, large = sorted((len(sets[a]), len(sets[b])))
        if not near and small >= jaccard * large and small:
            both = len(sets[a] & sets[b])
            near = both >= jaccard * (small + large - both)
        if near:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {k: find(k) for k in texts}


def brute_contaminated(text, items):
    """Whether any window of 13 words of an item (all of a shorter one) agrees in 80 % of its places."""
    number = {}
    words = lambda t: np.array([number.setdefault(w, len(number)) for w in (x.strip(decontaminate._ENDS).lower() for x in words_of(t)) if w])
    doc = words(text)
    for item in map(words, items):
        w = min(13, len(item))
        if not w or len(doc) < w:
            continue
        sums = [np.zeros(len(doc) + 1, int)]  # over diagonals
        for x in item:
            sums.append(np.concatenate([[0], sums[-1][:-1] + (doc == x)]))
        if any((sums[q + w][w:] - sums[q][: len(doc) + 1 - w]).max() >= 0.8 * w for q in range(len(item) - w + 1)):
            return True
    return False


def test_pipeline_against_stages_by_hand(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {k: r.text for k, r in docs.items() if not (rules.mask(rules.POLICIES["standard-v1"]) & failed(r.text))}
    tops = brute_near(kept, 0.8)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {k for k, top in tops.items() if k == top and not brute_contaminated(kept[k], items)}
    assert len(clean) < len(set(tops.values())) < len(kept) < len(docs)  # every stage decides something
    tok = encode.encoder(tokenfiles.VOCAB).tok
    n = {k: len(tok.encode(docs[k].text, add_special_tokens=False).ids) for k in clean}
    copies = Counter(r.doc_id for r in got)
    assert set(copies) == clean and set(copies.values()) <= {1, 2}
    totals, taken = Counter(), Counter()
    for k, c in copies.items():
        totals[docs[k].source] += n[k]
        taken[docs[k].source] += c * n[k]
    p = {s: t / sum(totals.values()) for s, t in totals.items()}
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        low, high = (low, a) if max(x ** (a - 1) for x in p.values()) / min(x ** (a - 1) for x in p.values()) <= mixing.MAX_REPEATS else (a, high)
    for s, share in p.items():  # short by less than the document that the budget cuts, over by less than one
        assert abs(taken[s] - share ** (high - 1) / min(x ** (high - 1) for x in p.values()) * totals[s]) <= max(n.values())
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = [*tok.encode(docs[r.doc_id].text, add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += r.n_tokens


def test_pipeline_of_empty_and_awkward_tables(spark, tmp_path, docs, empty):
    import corpus_pipeline

    plain = [c for c in docs.columns if c in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, table in (("none", empty), ("awkward", docs)):
        table.select(plain).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, rows()[4][1]), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "awkward")).collect()}
    assert got and 4 not in got and got <= {r[0] for r in rows() if len(words_of(r[1])) >= 50}


def failed(text):
    known = dict(zip(rules.MEASURES, rules.measure(text.encode()), strict=True))
    return sum(1 << r.bit for r in rules.RULES if eval(r.fails, {}, known))


def test_parities_never_rule_out_sets_that_are_similar():
    rng = np.random.default_rng(3)
    for n in (1, 5, 63, 64, 65, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for gone, new in ((0, 0), (n // 9, 0), (n // 20, n // 20), (n // 2, n // 2), (0, n // 4)):
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, new, np.uint64)]))
            if len(b):
                apart = len(np.setxor1d(a, b))
                assert simhash.least_difference(simhash.parity(a), simhash.parity(b)) <= apart
                assert simhash.least_difference(simhash.parity(b), simhash.parity(a)) <= apart
