"""Operators against brute force, the tokenizers library, and held-out documents."""

import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import language_id, license_scan
from tallyfield.llm.embedding_dedup import link_embeddings
from tallyfield.llm.minhash_dedup import COMPONENTS, least_equal, near_duplicates
from tallyfield.llm.packing import best_fit, library_words, pack_documents
from tallyfield.llm.sharding import shard_documents, write_shards
from tallyfield.llm.token_rollups import Rollup, bpe_counted, counted, deletes, inserts, revisions, word_count
from tallyfield.llm.url_filters import PATTERN_RULES, SITE_RULES
from tallyfield.llm.word_bpe import WordBpe, tokenizer_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def odd_texts(n):
    draw = random.Random(3)
    letters = "abcdefghij 's're\n\t.,!0123 ßİΣσςé  　\x1c\x1d\x01 中文🙂<|endoftext|> <|startoftext|>_½²٣Ａﬁ​\x85 àb 'S 'RE ǅ"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(n)] + ["a" * 900, " <|endoftext|>x<|startoftext|>"]


def test_both_encoders_equal_the_library(library, texts):
    cases = [t for _, t in texts] + odd_texts(3000)
    want = [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]
    for encoder in (WordBpe(tokenizer_path()), library_words(tokenizer_path())):
        assert [np.frombuffer(raw, "<u4").tolist() for raw in encoder.encode_batch(cases)] == want


def test_border_rule_equals_merging(texts):
    bpe = WordBpe(tokenizer_path())
    list(bpe.encode_batch([t for _, t in texts]))
    pairs = random.Random(5).sample(sorted(bpe.pair_ok.items()), 2000)
    for key, ok in pairs:
        left, right = divmod(key, bpe.n)
        assert ok == (bpe.merge(bpe.leaves(left) + bpe.leaves(right)) == [left, right])


def test_best_fit_takes_the_tightest_open_window():
    draw = np.random.default_rng(2)
    lengths = draw.integers(1, 41, 500)
    window, offset = best_fit(lengths, 40)
    rooms, want = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fitting = [r for r in rooms if r >= lengths[i]]
        if fitting:
            rooms[rooms.index(min(fitting))] -= lengths[i]
        else:
            rooms.append(40 - lengths[i])
        want.append(sorted(rooms))
    used = np.bincount(window, lengths)
    assert sorted(40 - used) == sorted(rooms) and used.max() <= 40
    for w in range(len(used)):
        at = np.flatnonzero(window == w)
        at = at[np.argsort(offset[at])]
        assert (offset[at] == np.concatenate([[0], np.cumsum(lengths[at])[:-1]])).all()


def test_packed_pieces_hold_the_ids(spark, library, texts):
    rows = pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), group_pieces=40).collect()
    ids = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in texts}
    used = {}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


def test_shards_are_even_gapless_and_keep_copies_together(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i, "w" * draw.randint(1, 400) + str(i)) for i in range(4000)] + [(10_000 + i, "one hot text " * 8) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard_documents(docs, 10).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and len(sizes) == 10 and sizes.max() <= 1.02 * sizes.mean() and sizes.min() >= 0.98 * sizes.mean()
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    texts = dict(rows)
    assert all(s == len(texts[i]) + 8 and c == zlib.crc32(texts[i].encode()) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    write_shards(docs, str(tmp_path / "shards"), 10)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 10


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(base, n, draw):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, texts, words):
    draw = random.Random(6)
    rows = [(i, t) for i, t in texts]
    start = max(i for i, _ in rows) + 1
    bases = [[f"w{draw.randrange(5000)}" for _ in range(draw.choice([12, 40, 120]))] for _ in range(6)]
    for base, n in zip(bases, (2, 3, 10, 60, 5, 200), strict=True):
        rows += [(start + len(rows) + k, t) for k, t in enumerate(near_copies(base, n, draw))]
    sets = {}
    for i, t in rows:
        tokens = t.encode().lower().split()
        width = min(words, len(tokens))
        sets[i] = {tuple(tokens[k : k + width]) for k in range(len(tokens) - width + 1)} if tokens else set()
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(sets, linked)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=words).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in got)


def hub_copies(n, seed, prefix="h"):
    """An original and copies that reach 0.8 with it but not with each other, in shingles of five words."""
    draw = random.Random(seed)
    base = [f"{prefix}{draw.randrange(10**6)}" for _ in range(404)]
    out = [" ".join(base)]
    for k in range(n):
        words = list(base)
        for at in draw.sample(range(5, 400, 6), 7):
            words[at] = f"{prefix}new{k}x{at}"
        out.append(" ".join(words))
    return out


def five_word_sets(texts):
    sets = []
    for text in texts:
        tokens = text.encode().lower().split()
        sets.append({tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4)})
    return sets


def test_hub_of_a_thousand_copies_is_one_component(spark):
    rows = list(enumerate(hub_copies(1000, 8)))
    sets = five_word_sets([t for _, t in rows])
    assert all(100 * len(sets[0] & s) >= 80 * len(sets[0] | s) for s in sets)
    assert sum(100 * len(a & b) >= 80 * len(a | b) for a, b in itertools.combinations(sets[1:300], 2)) == 0
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0} and [r["doc_id"] for r in got if r["kept"]] == [0]


def test_estimate_loses_less_than_the_orders_miss():
    for s in (0.8, 0.81, 0.9):
        lost = sum(math.comb(COMPONENTS, k) * s**k * (1 - s) ** (COMPONENTS - k) for k in range(least_equal(0.8)))
        assert lost < (1 - 0.8**4) ** 24


def test_embedding_links_equal_all_pairs(spark, monkeypatch):
    from tallyfield.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "STRIP", 100)
    draw = np.random.default_rng(8)
    far = draw.standard_normal((300, 8))
    hot = draw.standard_normal(8) + 0.05 * draw.standard_normal((250, 8))
    chain = np.stack([[np.cos(0.3 * k), np.sin(0.3 * k), *[0.0] * 6] for k in range(12)])
    x = np.concatenate([far, hot, chain, far[:5]])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    want = brute_components(range(len(x)), zip(*np.nonzero(linked), strict=True))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(linked.sum(axis=1).tolist()))
    assert {r["vec_id"]: r["component_id"] for r in got} == want


def test_vectors_are_written_once_and_not_once_per_partner(spark, monkeypatch):
    """Strips that meet many others are read by their tasks; disk holds every vector once, whatever the number of strips."""
    from tallyfield.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "STRIP", 20)
    monkeypatch.setattr(embedding_dedup, "RUN", 3)
    folders, sent = [], []
    work_path, kept = embedding_dedup.work_path, embedding_dedup.materialised
    monkeypatch.setattr(embedding_dedup, "work_path", lambda *a: folders.append(work_path(*a)) or folders[-1])
    monkeypatch.setattr(embedding_dedup, "materialised", lambda df, label: sent.append(df) or kept(df, label))
    draw = np.random.default_rng(9)
    x = np.repeat(draw.standard_normal((100, 6)), 4, axis=0) + 0.1 * draw.standard_normal((400, 6))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    got = link_embeddings(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(linked.sum(axis=1).tolist()))
    assert {r["vec_id"]: r["component_id"] for r in got} == brute_components(range(len(x)), zip(*np.nonzero(linked), strict=True))
    written = spark.read.parquet(folders[0])
    assert written.count() == written.select("node").distinct().count() == 400 and written.select("strip").distinct().count() > 20
    runs, found = (next(df for df in sent if c in df.columns) for c in ("t", "links"))
    assert runs.count() > 20 and max(len(r["t"]) for r in runs.collect()) <= 3
    assert "vector" not in found._jdf.queryExecution().executedPlan().toString()


def test_gradients_equal_differences():
    model = language_id.ByteGru(["x", "y"], hidden=3, seed=1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = language_id.padded([b"abc", b"de", b"fghij"])
    labels = np.array([0, 1, 1])
    model.h = 3

    def loss():
        p = model.probabilities(x, mask)
        return -(np.log(p[:, np.arange(3), labels]) * mask.T).sum()

    hidden, ft, bt = model.states(x, mask)
    prob = language_id._softmax(hidden @ model.p["out"] + model.p["bias"])
    wanted = np.zeros_like(prob)
    wanted[:, np.arange(3), labels] = 1
    up = ((prob - wanted) * mask.T[:, :, None]) @ model.p["out"].T
    grad = {k: np.zeros_like(v) for k, v in model.p.items()}
    model._backward(x, ft, up[:, :, :3], "f", grad)
    model._backward(x[:, ::-1], bt, up[::-1, :, 3:], "b", grad)
    for name, place in (("f_gates", (1, 4)), ("f_cand", (0, 2)), ("b_gates", (2, 0)), ("b_in", (ord("e"), 7)), ("f_in", (ord("a"), 2))):
        kept = model.p[name][place]
        values = []
        for step in (1e-3, -1e-3):
            model.p[name][place] = kept + step
            values.append(loss())
        model.p[name][place] = kept
        assert grad[name][place] == pytest.approx((values[0] - values[1]) / 2e-3, rel=0.02, abs=1e-3)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_license_gate_loses_no_match(texts):
    scan = license_scan.Scanner(license_scan.license_rules())
    cases = [t for _, t in texts] + [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: Apache-2.0",
        "MIT License. mit-license; see the MIT  LICENSE",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "Creative Commons Attribution-ShareAlike 4.0 International License",
    ]
    for text in cases:
        words = scan.words(text)
        joined = b" ".join(words)
        brute = set()
        for rule in license_scan.license_rules():
            for m in license_scan.re.finditer(rb"(?<![^ ])(?:" + rule.pattern.encode() + rb")(?![^ ])", joined):
                at = joined.count(b" ", 0, m.start())
                brute.add(license_scan.Detection(at, at + 1 + m.group().count(b" "), rule))
        assert set(scan.detect(words)) == brute


def examples(parsed):
    """All texts that a rule's expression stands for."""
    out = [""]
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            each = [chr(value)]
        elif kind == "IN":
            each = [chr(c) for k, v in value for c in (range(v[0], v[1] + 1) if str(k) == "RANGE" else [v])]
        elif kind == "BRANCH":
            each = [t for branch in value[1] for t in examples(branch)]
        elif kind == "SUBPATTERN":
            each = examples(value[-1])
        else:
            assert kind == "MAX_REPEAT" and value[:2] == (0, 1), kind
            each = ["", *examples(value[2])]
        out = [a + b for a in out for b in each]
    return out


def test_every_alternative_holds_its_keyword():
    from re import _parser

    for rule in license_scan.license_rules():
        assert all(rule.keyword in t for t in examples(_parser.parse(rule.pattern))), rule


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("licensed under the Free Public License", "0bsd"),
        ("Do What The Fuck You Want To Public License", "wtfpl"),
        ("licensed under the GNU General Public License version 1", "gpl-1.0"),
    ],
)
def test_license_names_without_an_abbreviation(text, label):
    scan = license_scan.Scanner(license_scan.license_rules())
    assert label in {d.rule.label for d in license_scan.unsuppressed(scan.detect(scan.words(text)))}


def test_license_suppression():
    scan = license_scan.Scanner(license_scan.license_rules())
    found = scan.detect(scan.words("Licensed under the GNU Lesser General Public License"))
    assert {d.rule.label for d in license_scan.unsuppressed([d for d in found if not d.rule.base])} == {"lgpl"}
    assert {d.rule.label for d in found if d.rule.base} == {"gpl"}
    many = scan.detect(scan.words("MIT License. mit-license; see the MIT  LICENSE"))
    assert [d.start for d in many if d.rule.base] == [0, 2, 6]


def test_every_rule_token_stands_in_its_urls():
    import re

    for rule in SITE_RULES:
        host, _, path = rule.rule.partition("/")
        assert set(rule.tokens) <= set(re.split("[^a-z0-9]+", f"http://www.{host}/{path}/x"))
    assert all(r.tokens for r in (*SITE_RULES, *PATTERN_RULES))


def test_no_rule_token_stands_at_an_open_end():
    import re

    assert not [r for r in PATTERN_RULES if r.tokens and r.pattern.endswith(r.tokens[-1])]
    for url in ("http://a.com/banner/x.swfx", "http://a.com/wp-login.php5", "http://a.com/xmlrpc.php7", "http://a.com/calendar/2020/01/02/printable"):
        met = [r for r in PATTERN_RULES if re.search(r.pattern, url)]
        assert met and all(set(r.tokens) <= set(re.split("[^a-z0-9]+", url)) for r in met)


def test_rollup_batches_count_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "s", "en"), (2, "d e", "s", "en"), (3, "f", "t", None)], "doc_id long, text string, source string, lang string")
    rows = counted(docs, {"v1": word_count(docs["text"])})
    path = str(tmp_path / "rollup")
    rollup = Rollup(spark, path)
    assert rollup.totals().collect() == []
    assert rollup.commit("1", inserts(rows)) and not rollup.commit("1", inserts(rows))
    after = rows.where("doc_id = 1").replace("s", "u", "source")
    assert rollup.commit("2", revisions(rows.where("doc_id = 1"), after)) and rollup.commit("3", deletes(rows.where("doc_id = 3")))
    (tmp_path / "rollup" / "batch-4").mkdir()
    again = Rollup(spark, path)
    assert again.committed() == ["1", "2", "3"]
    assert again.commit("4", inserts(rows.where("doc_id = 3")))
    got = {(r["source"], r["lang"], r["documents"], r["tokens"]) for r in again.totals().collect()}
    assert got == {("s", "en", 1, 2), ("u", "en", 1, 3), ("t", None, 1, 1)}
    assert bpe_counted(docs).agg({"tokens": "sum"}).collect()[0][0] == 6


def test_pipeline_stages_equal_brute_force(spark):
    import duckdb

    import corpus_pipeline
    from tallyfield.llm.quality_rules import QUALITY_SQL

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = corpus_pipeline.quality(spark, docs, FOLDER).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, chars_left FROM ({QUALITY_SQL}) WHERE kept").fetchall()}
    assert {r["doc_id"]: len(r["text"]) for r in first} == want == {r["doc_id"]: r["n_chars"] for r in first}
    second = corpus_pipeline.language(spark, spark.createDataFrame(first, docs.schema), FOLDER)
    model = language_id.fit(spark.createDataFrame(first, docs.schema), "doc_id", "text", "lang")
    scores = language_id.RunScores(model)
    alone = {r["doc_id"] for r in first if (s := scores.score([r["text"]])[0])[-1] and s[:-1].max() >= 0.4 * s[-1]}
    second = second.collect()
    assert {r["doc_id"] for r in second} == alone
    third = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(second, docs.schema), FOLDER).collect()
    sets = {}
    for r in second:
        tokens = r["text"].encode().lower().split()
        width = min(5, len(tokens))
        sets[r["doc_id"]] = {tuple(tokens[k : k + width]) for k in range(len(tokens) - width + 1)}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in third} == set(brute_components(sets, linked).values())
    pieces = corpus_pipeline.packing(spark, spark.createDataFrame(third, docs.schema), FOLDER).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in third}


def test_pipeline_stage_keeps_one_document_of_a_hub_group(spark):
    import corpus_pipeline

    rows = [(k, t) for k, t in enumerate(hub_copies(400, 9))] + [(1000, "a document of its own about other things")]
    sets = five_word_sets([t for _, t in rows[:401]])
    assert all(100 * len(sets[0] & s) >= 80 * len(sets[0] | s) for s in sets)
    assert not any(100 * len(a & b) >= 80 * len(a | b) for a, b in itertools.combinations(sets[1:], 2))
    stage = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER)
    assert sorted(r["doc_id"] for r in stage.collect()) == [0, 1000]


def test_long_words_merge_like_short_ones_and_in_time(library):
    """80,000 random letters in one word, in ranks' order from a heap, against the library."""
    bpe = WordBpe(tokenizer_path())
    rng = random.Random(5)
    for n in (1, 2, 48, 49, 50, 300):
        for letters in ("a", "ab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz0"):
            symbols = bpe.symbols("".join(rng.choices(letters, k=n)))
            assert bpe.merge_long(symbols) == bpe.merge(symbols) == merged_slowly(bpe, symbols)
    word = "".join(rng.choices("etaoinshrdlucmf", k=80_000))
    began = time.process_time()
    (ids,) = bpe.encode_batch([word])
    assert time.process_time() - began < 3
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def merged_slowly(bpe, tokens):
    tokens = list(tokens)
    while found := [(bpe.rank[p], i) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in bpe.rank]:
        _, i = min(found)
        tokens[i : i + 2] = [bpe.merged[(tokens[i], tokens[i + 1])]]
    return tokens


def test_suppression_sweep_equals_all_pairs():
    rng = random.Random(8)
    for size in (0, 1, 5, 60, 200):
        found = []
        for i in range(size):
            start, priority = rng.randrange(40), rng.choice([50, 60, 70, 100])
            found.append(license_scan.Detection(start, start + rng.randrange(1, 12), license_scan.LicenseRule(f"l{i}", "x", "x", priority)))
        over = lambda k, d: k.rule.priority > d.rule.priority or (k.rule.priority == d.rule.priority and k.end - k.start > d.end - d.start)
        want = [d for d in found if not any(k.start <= d.start and d.end <= k.end and over(k, d) for k in found)]
        assert {d.rule.label for d in license_scan.unsuppressed(found)} == {d.rule.label for d in want}


def test_language_sample_is_bounded_when_one_id_holds_most_rows(spark):
    """An id with thousands of equal rows and one with many texts take no more than their places."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000)]
    rows = [(1, " ".join(words[:60]), "en")] * 3000 + [(3, " ".join(words[i : i + 60]), "en") for i in range(900)]
    rows += [(i, " ".join(words[i : i + 5]), "fr") for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    runs = language_id.training_runs(docs, "doc_id", "text", "lang", 50)
    per = {r["lang"]: r for r in runs.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("doc_id", "print").alias("docs")).collect()}
    learned = spark.createDataFrame([(1,), (3,)], "doc_id long").where(~language_id.held_out(F.col("doc_id"))).count()
    assert learned == 2 and per["en"]["docs"] == 50 and per["fr"]["docs"] == 50
    assert per["en"]["n"] <= 50 * language_id.RUNS_PER_DOC
    assert runs.groupBy("lang", "doc_id", "print", "run").count().where("count > 1").count() == 0


def test_equal_rows_are_dealt_in_several_slot_groups(spark):
    """Rows that agree in id and text stay in one shard; slots are gapless and every row has its own."""
    rows = [(7, "same text")] * 3000 + [(i, f"text {i}") for i in range(3000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=4).toPandas()
    assert len(got) == 6000 and got[got.doc_id == 7].groupby("text_crc32").shard.nunique().max() == 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
