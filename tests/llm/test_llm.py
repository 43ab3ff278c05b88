"""The llm operators against brute force, round trips, held-out labels and edge rows."""

from __future__ import annotations

import collections
import html as entities
import itertools
import pathlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SMALL
from memengine.llm import chat, graph, html_text, id_files, language_id, line_quality, mixing, ngram_join, packing
from memengine.llm import scratch, sharding, suffix_dedup, tokens, voronoi, words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank string"
LONG = " ".join(f"w{i}" for i in range(30_000))
TURNS = "conv_id bigint, turn bigint, role string, text string"
ODD = [
    (None, "no id here", "en", "a", 10, "x"), (1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (3, " \n\t ", "en", None, 4, "x"),
    (4, "one two three", "en", "a", 13, "x"), (5, "ONE two three", "en", "b", 13, "x"), (6, LONG, "en", "b", len(LONG), "x"),
    (7, "<|endoftext|> a  b\t c é😀.", "xx", "b", 1, "x"), (8, LONG + " tail", None, "a", 5, "x"), (4, "one two three", "en", "a", 13, "x"),
]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def small(spark, table="documents"):
    return spark.read.parquet(f"{SMALL}/{table}.parquet")


def near_copies(n=60, edits=6):
    """Texts that differ from one base in a few words each, and others that share only a passage."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(220)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(len(copy))] = f"e{rng.random()}"
        texts.append(" ".join(copy))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join(f"x{rng.random()}" for _ in range(150)) + " " + passage for _ in range(40)]
    return texts


def shingles(text):
    found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4)) if len(found) >= 5 else frozenset([tuple(found)] if found else [])


def linked(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent, degree = {i: i for i in sets}, collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                degree[a] += 1
                degree[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), degree[i]) for i in ids}


def joined(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_groups(df, **options).collect()}


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = ["a b", None, "", " a\tb\n", "b" * 70_000 + " a"]
    found = words.words_of(pa.array(texts))
    names = [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(found.first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert len(set(zip(names, found.hashes.tolist()))) == len(set(names)) == len(set(found.hashes.tolist()))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {n: root(n) for n in list(parent)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_ngram_join_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in small(spark).select("doc_id", "text").collect()]
    assert joined(small(spark)) == linked(rows)
    rows = list(enumerate(near_copies() + near_copies()[:3]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert joined(df) == joined(df, pair_limit=3, block=7) == linked(rows)


def test_ngram_join_of_sets_without_a_bound(spark, monkeypatch):
    rows = list(enumerate(near_copies(20)))
    monkeypatch.setattr(ngram_join, "slack", lambda values, percent: 0)
    sets = [np.sort(np.arange(200, dtype=np.uint64)), np.sort(np.arange(3, dtype=np.uint64))]
    assert all(len(ngram_join.signatures(s, -1, 75)) == len(s) for s in sets)
    assert joined(spark.createDataFrame(rows, "doc_id bigint, text string")) == linked(rows)


def test_ngram_join_of_odd_rows(spark):
    got = joined(docs_of(spark, ODD))
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8} and got[1] == (0, 1, 0) and got[3] == (0, 3, 0)
    assert got[5] == (1, 4, 1) and got[8][1] == 6
    assert joined(docs_of(spark, [])) == {}
    kept = ngram_join.first_of_groups(docs_of(spark, ODD))
    assert kept.columns == docs_of(spark, []).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 4, 6, 7)] + [(True, 0)]


def test_equal_sets_sign_once(spark, monkeypatch):
    met, saved = [], scratch.saved

    def counted(df, name):
        out = saved(df, name)
        if name == "met":
            met.append(out.count())
        return out

    monkeypatch.setattr(scratch, "saved", counted)
    texts = near_copies(20)
    once = joined(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    rows = [(i + 1000 * k, t) for k in range(5) for i, t in enumerate(texts)]
    assert joined(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == linked(rows)
    assert len(once) == len(texts) and met[0] == met[1] > 0


def test_signatures_as_bytes():
    rng = np.random.default_rng(5)
    sigs = np.sort(rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    ids = np.r_[-(1 << 63), (1 << 63) - 1, 0, rng.integers(-50, 50, 497)].astype(np.int64)
    place, kind, rows = ngram_join._blobs(sigs >> np.uint64(62), sigs, ids, 2)
    assert sorted(place) == [0, 1, 2, 3] and kind == [2] * 4
    got = ngram_join._from_blobs(rows)
    assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip((sigs >> np.uint64(8)).tolist(), ids.tolist()))
    assert [len(x) for x in ngram_join._from_blobs([])] == [0, 0] and ngram_join._blobs(sigs[:0], sigs[:0], ids[:0], 0) == ([], [], [])


def passages(rows, n):
    places = collections.defaultdict(list)
    for i, text in rows:
        found = WORD.findall(text or "")
        for at in range(len(found) - n + 1):
            places[tuple(found[at : at + n])].append((i, at))
    return {(*p, k == 0) for v in places.values() if len(v) > 1 for k, p in enumerate(sorted(v))}


@pytest.mark.parametrize("min_words,window,gram", [(50, 20, 8), (12, 4, 3)])
def test_repeats_equal_brute_force(spark, min_words, window, gram):
    rows = [(r.doc_id, r.text) for r in small(spark).select("doc_id", "text").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(near_copies(15))] + [(2000, "la " * 300), (2001, None), (2002, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = suffix_dedup.repeats(df, min_words, window, gram)
    assert {tuple(r) for r in got.collect()} == passages(rows, min_words)
    covered = collections.defaultdict(set)
    for i, at, first in passages(rows, min_words):
        covered[i].update(range(at, at + min_words))
    spans = suffix_dedup.spans(got, min_words).collect()
    assert {i: sum(r.n_words for r in spans if r.doc_id == i) for i in covered} == {i: len(v) for i, v in covered.items()}


def test_cut_leaves_one_copy(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"start one {passage} end one", "en", "a", 1, "x"), (2, f"  begin two\n{passage}\tclose two ", "en", "a", 1, "x"), (3, passage, "en", "a", 1, "x")]
    out = {r.doc_id: r for r in suffix_dedup.without_repeats(docs_of(spark, rows)).collect()}
    assert set(out) == {1, 2} and out[1].text == rows[0][1] and out[2].text == "  begin two\nclose two " and out[2].n_chars == len(out[2].text)
    odd = suffix_dedup.without_repeats(docs_of(spark, ODD))
    assert odd.columns == docs_of(spark, []).columns
    assert sorted(str(r.doc_id) for r in odd.collect()) == sorted(["None", "1", "2", "3", "4", "4", "5", "6", "7", "8"])
    assert {r.doc_id: r.text for r in odd.collect()}[8] == "tail"
    assert suffix_dedup.without_repeats(docs_of(spark, [])).count() == 0 and suffix_dedup.repeats(docs_of(spark, [])).count() == 0


def reference_ids(texts):
    tool = Tokenizer.from_file(TOKENIZER)
    tool.encode_special_tokens = True
    return [tool.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_equals_the_tokenizer(spark):
    odd = [
        None, "", "a  b", " a", "a ", "   ", "\n\n a", "a\n\n\nb  c   ", "a\tb c\x1cd !\x1c x", "don't 'll x'", "<|endoftext|> x", "x" * 200 + " y",
        "\nfoo", "a \n b\n  c", "日本 語 　 x", "a 😀 b", "a*** b*'s c'*** ...", "x_ y__ 3* 4.5, é., ñ».",
    ]
    texts = odd + [r.text for r in small(spark).select("text").limit(60).collect()]
    for kept in (tokens.KEPT_PARTS, 50):
        assert [x.tolist() for x in tokens.Encoder(TOKENIZER, kept).encode(texts)] == reference_ids(texts)


def test_space_at_the_end_of_a_text_stays_with_it():
    tool = tokens.Encoder(TOKENIZER)
    parts = ["\n", "\n\n", " ", "\n\nThe", "\n The", " The", "  \nThe", "x"]
    want = dict(zip(parts, reference_ids(parts)))
    for order in itertools.permutations(parts, 4):
        tool.known.clear()
        tool._cut(list(order))
        assert {p: np.frombuffer(ids, dtype="<u4").tolist() for p, ids in tool.known.items()} == {p: want[p] for p in order}
    rng = random.Random(6)
    texts = [f"w{i}" + rng.choice(["\n", "\n\n", " ", " \n ", "\n\nword", "\n word", "\n\nThe end\n"]) for i in range(400)]
    known = dict(zip(texts, reference_ids(texts)))
    for kept in (tokens.KEPT_PARTS, 5):
        tool = tokens.Encoder(TOKENIZER, kept)
        for _ in range(10):
            rng.shuffle(texts)
            for low in range(0, len(texts), 40):
                some = texts[low : low + 40]
                assert [x.tolist() for x in tool.encode(some)] == [known[t] for t in some]


def check_packing(rows, texts, capacity):
    want = collections.Counter()
    for doc, text in texts:
        ids = reference_ids([text])[0] + [0]
        for piece, (low, high) in enumerate(zip(cuts := [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)], cuts[1:])):
            want[doc, piece, low, high - low, zlib.crc32(np.array(ids[low:high], dtype="<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_is_whole_and_tight(spark):
    rows = [(r.doc_id, r.text) for r in small(spark).select("doc_id", "text").collect()]
    got = packing.pack_documents(small(spark), TOKENIZER).collect()
    n = check_packing(got, rows, 2048)
    assert n <= -(-sum(r.length for r in got) // 2048) + 1
    check_packing(packing.pack_documents(docs_of(spark, ODD), TOKENIZER, 64).collect(), [(r[0], r[1]) for r in ODD], 64)
    assert packing.pack_documents(docs_of(spark, []), TOKENIZER).count() == 0


def test_crossing_keeps_every_piece():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 100, 300))[::-1]
    a, b = packing.evolve(sizes, [], 1, 100)[0], packing.evolve(sizes, [], 2, 100)[-1]
    child = packing.crossed(sizes, sizes.tolist(), a, b, rng, 100)
    assert (child >= 0).all() and np.bincount(child, weights=sizes).max() <= 100


def thirds(n, capacity, seed):
    """Pieces of about a half, a third and a sixth, that fill ``n`` bins exactly; best fit by falling size needs more."""
    rng = np.random.default_rng(seed)
    halves = capacity // 2 + rng.integers(-capacity // 20, capacity // 20 + 1, n)
    others = capacity // 3 + rng.integers(-capacity // 30, capacity // 30 + 1, n)
    return np.sort(np.r_[halves, others, capacity - halves - others])[::-1].copy()


def best_fit_bins(sizes, capacity):
    return packing.best_fit(sizes.tolist(), range(len(sizes)), np.empty(len(sizes), dtype=np.int32), [], 0, capacity)


@pytest.mark.parametrize("n, capacity", [(150, 2048), (400, 2048), (400, 120)])
def test_crossings_and_migration_beat_best_fit(n, capacity, monkeypatch):
    sizes = thirds(n, capacity, 1)
    count = lambda islands: [int(e[0].max()) + 1 for e in islands]
    islands = [packing.evolve(sizes, [], k, capacity) for k in range(3)]
    crossed = count(islands)
    monkeypatch.setattr(packing, "GENERATIONS", 0)  # the same first packings, never crossed
    assert min(crossed) < best_fit_bins(sizes, capacity) and sum(crossed) <= sum(count([packing.evolve(sizes, [], k, capacity) for k in range(3)]))
    monkeypatch.undo()
    moved = [packing.evolve(sizes, [*islands[(k - 1) % 3], islands[k][0]], 10 + k, capacity) for k in range(3)]
    assert all(now <= min(crossed[k], crossed[(k - 1) % 3]) for k, now in enumerate(count(moved)))


def test_packed_tables_beat_best_fit(spark):
    sizes = thirds(400, 2048, 2)
    pieces = spark.createDataFrame([(i, int(x)) for i, x in enumerate(sizes)], "doc_id bigint, length int")
    rows = packing.packed(pieces).collect()
    bins = collections.defaultdict(int)
    for r in rows:
        bins[r.sequence_id] += r.length
    assert len(rows) == 1200 and max(bins.values()) <= 2048 and 400 <= len(bins) < best_fit_bins(sizes, 2048)


def test_id_files_round_trip(spark):
    for df in (small(spark), docs_of(spark, ODD), docs_of(spark, [])):
        path = scratch.folder(spark, "ids")
        got = id_files.read(path, id_files.write(df, path, TOKENIZER)).collect()
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect()))
        want, start = [], 0
        for known, doc, text in rows:
            ids = reference_ids([text])[0] + [0]
            want.append((doc if known else None, start, len(ids), np.array(ids, dtype="<u4").tobytes()))
            start += len(ids)
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.start, r.n_tokens, bytes(r.ids))) for r in got)
    path = scratch.folder(spark, "ids")
    id_files.write(docs_of(spark, ODD), path, TOKENIZER)
    keys = spark.createDataFrame([(4,), (8,), (99,), (-5,), (None,)], "doc_id bigint")
    found = id_files.find(spark, path, keys)
    assert sorted(r.doc_id for r in found.collect()) == [4, 4, 8]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 5000).astype(np.uint64))
    assert sorted(id_files.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))
    index = id_files.Index.load(id_files.Index.of(keys.view(np.int64), np.ones(len(keys), bool), np.ones(len(keys), int), 2).dump())
    absent = np.arange(1, 2000, dtype=np.int64)
    assert (index.lookup(absent)[1] > 0).sum() <= 2 and (index.lookup(keys.view(np.int64))[1] == 1).all()


def test_language_on_held_out_labels(spark):
    df = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    found = language_id.predict(df, language_id.fitted(df)).filter(language_id.held_out())
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97
    odd = {(r.doc_id, r.text and r.text[:3]): r for r in language_id.predict(docs_of(spark, ODD), language_id.fitted(df)).collect()}
    assert [odd[k].lang_pred for k in ((1, None), (2, ""), (3, " \n\t"))] == ["und"] * 3 and all(0 <= r.score <= 1 for r in odd.values())
    nothing = language_id.learn(docs_of(spark, []))
    assert nothing == {} and {r.lang_pred for r in language_id.predict(docs_of(spark, ODD), {}).collect()} == {"und"}
    assert language_id.predict(docs_of(spark, []), {"en": b"text"}).count() == 0


def test_language_equals_a_plain_loop_of_compressors(spark):
    import zstandard

    df = small(spark)
    model = language_id.fitted(df)
    rows = df.orderBy("doc_id").limit(60).unionByName(docs_of(spark, [r for r in ODD if r[0] is not None]).select(df.columns))
    got = sorted((r.doc_id, r.text or "", r.lang_pred, round(r.score, 12)) for r in language_id.predict(rows, model).collect())
    want = []
    for r in rows.collect():
        letters = " ".join(re.findall(r"[^\W\d_]+", (r.text or "").lower()))
        sizes = []
        for lang, content in model.items():
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            tool = zstandard.ZstdCompressor(level=6, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
            raw = letters.encode()
            sizes.append((sum(len(tool.compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096)), lang))
        order = sorted(sizes, key=lambda s: s[0])
        told = (order[0][1], round((order[1][0] - order[0][0]) / order[1][0], 12)) if letters else ("und", 0.0)
        want.append((r.doc_id, r.text or "", *told))
    assert got == sorted(want)


def test_language_is_learned_from_all_places_of_a_text(spark):
    rng = random.Random(7)
    names = {lang: [lang + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)] for lang in ("p", "q")}

    def some(lang, n):
        return " ".join(rng.choice(names[lang]) for _ in range(n))

    rows = [(i, some("qp"[i % 2], 200) + " " + some("pq"[i % 2], 1200), "pq"[i % 2], "a", 1, "x") for i in range(120)]
    model = language_id.learn(docs_of(spark, rows), sample_docs=30)
    asked = [(i, some("pq"[i % 2], 60), "pq"[i % 2], "a", 1, "x") for i in range(60)]
    assert all(r.lang == r.lang_pred for r in language_id.predict(docs_of(spark, asked), model).collect())
    few = language_id.learn(docs_of(spark, rows), sample_docs=30, sample_chars=70)
    assert {k: len(v) <= 30 * 71 for k, v in few.items()} == {"p": True, "q": True}
    short = language_id.learn(docs_of(spark, [(1, "just so", "p", "a", 1, "x"), (2, "", "p", "a", 1, "x")]))
    assert b"just so" in short["p"]


def test_mixture_meets_its_targets(spark):
    rows = mixing.mixture(small(spark)).collect()
    assert rows == mixing.mixture(small(spark)).collect() or sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixture(small(spark)).collect()))
    sizes = collections.Counter()
    for r in small(spark).collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    targets, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            targets |= share
            break
        targets |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_mixture_takes_the_least_odds_first(spark):
    """The ranking by hand: the level of each source, whole copies, then documents in the order of their odds."""
    df = small(spark)
    got = {r.doc_id: r for r in mixing.mixture(df).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(mixing.SEED)), F.lit(1 << 52))
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or "")), (r.u + 0.5) / 2**52) for r in df.withColumn("u", draw).collect()]
    appeal = lambda size: 1 + size.bit_length() / 8 if size else 1 + 1 / 8
    for source in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == source]
        target = got[mine[0][0]].target
        low, high = 0.0, 4.0
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(size * min(2, level * appeal(size)) for _, _, size, _ in mine) < target else (low, level)
        taken, ranked = {}, []
        for doc, _, size, u in mine:
            expected = min(2.0, high * appeal(size))
            whole = int(expected + 1e-9)
            taken[doc] = whole * size
            share = expected - whole
            if share > 1e-9 and size:
                ranked.append(((u / (1 - u)) / (share / (1 - share)), doc, size))
        left = max(0, round(target) - sum(taken.values()))
        for _, doc, size in sorted(ranked):
            taken[doc] += min(size, left)
            left -= min(size, left)
        assert taken == {doc: got[doc].taken for doc, *_ in mine}


def test_mixed_rows_are_what_the_mixture_takes(spark):
    for df in (small(spark), docs_of(spark, ODD)):
        out = mixing.mixed(df)
        assert out.columns == df.columns
        got = out.agg(F.sum(mixing.word_count())).first()[0]
        assert got == mixing.mixture(df).agg(F.sum("taken")).first()[0]
    assert mixing.mixture(docs_of(spark, ODD)).count() == len(ODD)
    assert mixing.mixture(docs_of(spark, [])).count() == 0 and mixing.mixed(docs_of(spark, [])).count() == 0


def test_long_boundary_document_is_cut_at_its_word(spark):
    for n, percent, cut in ((20_000, 175, 15_000), (300_000, 150, 150_000)):
        text = " " + "".join(f"w{i}" + (" ", "\n", " \t ")[i % 3] for i in range(n))
        out = mixing.mixed(docs_of(spark, [(1, text, "en", "a", len(text), "x")]), percent=percent).collect()
        want = text[: list(WORD.finditer(text))[cut - 1].end()]
        assert sorted((r.text, r.n_chars) for r in out) == sorted([(text, len(text)), (want, len(want))])


def test_inclusion_is_unequal_and_even(spark):
    rows = [(i, "w " * (10 if i % 2 else 1000), "en", "a" if i < 4000 else "b", 1, "x") for i in range(4400)]
    got = mixing.mixture(docs_of(spark, rows)).filter("source = 'a'").groupBy((F.col("size") > 100).alias("long")).agg(
        F.avg(F.col("taken") / F.col("size")).alias("share")
    )
    share = {r.long: r.share for r in got.collect()}
    assert share[True] > share[False] > 0


def test_line_quality_of_odd_rows(spark):
    good = "This is a clean sentence of a page.\n" * 1 + "Here follows another one, which is not like it.\nAnd a third ends the text."
    junk = "Home | About | Contact | Help\nWe use cookies to track you everywhere you go.\nRead more about that on the other page\n" + "Ten good words stand here."
    rows = [*ODD, (20, good, "en", "a", 1, "x"), (21, junk, "en", "a", 1, "x"), (22, "SHOUT OUT LOUD NOW. " * 5, "en", "a", 1, "x"), (23, "a ### b ### c. " * 9, "en", "a", 1, "x")]
    out = line_quality.cleaned(docs_of(spark, rows))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and "rank" in out.columns
    assert [got[i].n_words for i in (1, 2, 3)] == [0, 0, 0] and all(got[i].base_failed and not got[i].kept for i in (1, 2, 3, 4))
    assert got[20].kept and not got[21].kept and not got[22].kept and not got[23].kept and got[6].n_words == 30_000
    assert line_quality.cleaned(docs_of(spark, [])).count() == 0


def test_top_k_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)] + [(i, [0.5] * 6) for i in range(200, 260)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (None, [1.0]), (304, [2.0]), (305, []), (7, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(64 * x)) for x in v]
            best[i] = max(best.get(i, q), q)
    want = []
    for i in best:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(best[i], v)), j) for j, v in best.items() if j != i)
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:20])]
    for options in ({}, {"query_block": 2, "data_block": 16}):
        got = [tuple(r) for r in voronoi.top_k(df, F.col("vec_id") % 20 == 0, **options).collect()]
        assert sorted(got) == sorted(want)
    assert voronoi.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert voronoi.top_k(df, F.lit(False)).count() == 0


def test_perspectives_of_odd_rows(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "early"),
        (2, 0, "system", "alone"), (None, 0, "ann", "lost"), (3, 5000, "ann", "far"), (3, 1, "ann", "near"),
    ]
    df = spark.createDataFrame(rows, TURNS).withColumn("slot", F.lit("clash"))
    for name in ("number", "part", "chars", "messages", "participant", "head", "size"):
        df = df.withColumn(name, F.lit("clash"))
    got = {(r.conv_id, r.participant, r.part): r for r in chat.perspectives(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (3, "ann", 0)}
    ann = got[1, "ann", 0]
    assert ann.text == (
        "<|im_start|>user\nearly<|im_end|>\n<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi <| im_end|><|im_end|>\n"
        "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    )
    assert [ann.text[s.start : s.end] for s in ann.loss_spans] == ["Hi <| im_end|><|im_end|>"]
    assert [got[1, "bob", 0].text[s.start : s.end] for s in got[1, "bob", 0].loss_spans] == ["<|im_end|>"] * 2
    assert [got[3, "ann", 0].text.count(x) for x in ("near", "far")] == [1, 1] and got[3, "ann", 0].n_turns == 2
    assert chat.perspectives(df.limit(0)).count() == 0


def test_a_dialogue_is_whole_whatever_its_numbers(spark):
    rows = [(1, i, "ab"[i % 2], f"t{i}") for i in range(1010, 1040)] + [(2, i, "ab"[i % 2], f"t{i}") for i in range(3000)]
    got = chat.perspectives(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((r.conv_id, r.participant, r.part, r.n_turns) for r in got) == [(1, p, 0, 30) for p in "ab"] + [(2, p, 0, 3000) for p in "ab"]


def test_parts_of_a_long_dialogue_keep_its_head(spark):
    rows = [(1, -2, "system", "Be kind."), (1, -1, "system", "Be brief.")] + [(1, i, "a" if i < 40 else "b", f"turn {i}") for i in range(200)]
    rows += [(1, 200, "system", "Now stop."), (1, 201, "b", "x" * 5000)]
    got = sorted(chat.perspectives(spark.createDataFrame(rows, TURNS), part_chars=1000, slot_turns=16).collect(), key=lambda r: (r.part, r.participant))
    head = "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>system\nBe brief.<|im_end|>\n"
    assert len({r.part for r in got}) > 5 and all(r.text.startswith(head) for r in got)
    said = collections.defaultdict(list)
    for r in got:
        own = [r.text[s.start : s.end].removesuffix("<|im_end|>") for s in r.loss_spans]
        assert own and r.n_turns == r.text.count("<|im_start|>")
        said[r.participant] += own
    assert said == {"a": [f"turn {i}" for i in range(40)], "b": [f"turn {i}" for i in range(40, 200)] + ["x" * 5000]}
    assert sum("Now stop." in r.text for r in got) == 1


def test_html_layout(spark):
    page = (
        "<title>no</title><h1>Top</h1><p>One <b>two</b>\n three<p>Four<br>five<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>"
        "<table><tr><th>Name<th>Qty<tr><td>Apple<td>10</table><div hidden>no</div><i style='display:none'>no</i><pre>  a\n   b</pre>"
        "<script>no</script>A &amp; B"
    )
    want = "Top\n\nOne two three\n\nFour\nfive\n\n- a\n- b\n  3. x\n  4. y\n\nName   Qty\nApple  10\n\n  a\n   b\n\nA & B"
    rows = [(1, page), (1, page), (2, None), (3, ""), (None, "<p>x"), (4, "<div>" * 3000 + "deep"), (5, "<<>&#0; <a"), (6, "w " * 200_000)]
    df = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("text", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in html_text.rendered(df).collect():
        got[r.page_id].append(r.text)
    assert got[1] == [want, want] and got[2] == got[3] == [""] and got[None] == ["x"] and got[4] == ["deep"] and len(got[6][0]) == 399_999
    assert html_text.rendered(df.limit(0)).count() == 0
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").limit(20).collect():
        text = html_text.visible_text(r.html)
        body = re.sub(r"<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", r.html, flags=re.S)
        import html as entities

        seen = entities.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        assert sorted("".join(seen)) == sorted("".join(re.sub(r"^\s*(- |\d+\. )", "", text, flags=re.M).split()))


def test_html_of_any_depth():
    for tag in ("div", "b", "span", "blockquote", "ul><li", "table><tr><td"):
        ends = "".join(f"</{t}>" for t in reversed(tag.split("><")))
        for depth in (10, 149, 150, 400, 5000):
            inner = "<p>seen<script>no</script><style>no</style><span hidden>no<b>no</b></span><div style='display:none'>no<div>no</div>no</div><p>too"
            text = html_text.visible_text(f"<{tag}>" * depth + inner + ends * depth + "<p>after")
            assert [w for w in text.split() if w != "-"] == ["seen", "too", "after"]
    page = "<div hidden>" + "<b>" * 200 + "<div>no</div>no" + "</b>" * 200 + "no</div>yes"
    assert html_text.visible_text(page) == "yes"
    assert html_text.visible_text("<table><tr><td>" + "<div>" * 200 + "<table><tr><td>x</table>y" + "</div>" * 200 + "<td>z</table>").split() == ["x", "z", "y"]


def test_html_row_spans():
    page = "<table><tr><td rowspan=2>A<td>B<td>C<tr><td>D<td rowspan=0>E<tr><td>F<td>G<tr></tr><tr><td>H<tbody><tr><td>I<td>J<td>K</table>"
    assert html_text.visible_text(page) == "A  B  C\n   D  E\nF  G\nH\nI  J  K"
    page = "<table><tr><td>A<td rowspan=3>B<td>C<tr><td colspan=2>DDDDDDDDDDD<tr><tr><td>E<td>F</table>"
    assert html_text.visible_text(page).split() == ["A", "B", "C", "DDDDDDDDDDD", "E", "F"]


def test_every_page_is_rendered_whole():
    pages = pq.read_table(f"{SMALL}/pages.parquet").column("html").to_pylist()
    assert pages

    def differs(page, text):
        body = re.sub(r"<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style|title)\b.*?</\1>", "", page, flags=re.S)
        want = "".join(entities.unescape(re.sub(r"</?[a-zA-Z][^>]*>", " ", body)).split())
        return want != "".join(re.sub(r"^ *- ", "", text, flags=re.M).split())

    texts = [html_text.visible_text(page) for page in pages]
    assert not any(map(differs, pages, texts))
    assert all(differs(page, text[: len(text) // 2]) for page, text in zip(pages, texts))


def test_shuffle_files_go_with_their_plan(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def files():
        return {f for d in folders for f in pathlib.Path(d.getPath()).rglob("shuffle_*.data")}

    before, setting = files(), spark.conf.get(scratch.SHUFFLES_GO)
    df = spark.range(10_000).repartition(4, "id")
    assert df.count() == 10_000 and (left := files() - before)
    out = scratch.saved(df.withColumn("twice", F.col("id") * 2), "shuffled")
    until = time.time() + 20
    while files() - before - left and time.time() < until:
        time.sleep(0.2)
    assert not files() - before - left and out.count() == 10_000 and spark.conf.get(scratch.SHUFFLES_GO) == setting


def test_pipeline_stages(spark):
    docs = small(spark)
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = docs
        docs = scratch.saved(stage(spark, given, SMALL), name)
        assert docs.columns == columns
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        if name == "language_id":
            assert len(rows) > 0.97 * before
        if name == "ngram_join":
            want = linked([(r.doc_id, r.text) for r in given.select("doc_id", "text").collect()])
            assert {i for i, _ in rows} == {i for i, (_, root, _) in want.items() if i == root}
        if name == "suffix_dedup":
            later = {i for i, _, first in passages([(r.doc_id, r.text) for r in given.select("doc_id", "text").collect()], 50) if not first}
            same = {r.doc_id: r.text for r in given.collect()}
            assert all(t == same[i] for i, t in rows if i not in later) and set(same) - later <= {i for i, _ in rows}
    out = corpus_pipeline.run(spark, SMALL)
    n = check_packing(out.collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 2048)
    assert n <= -(-out.agg(F.sum("length")).first()[0] // 2048) + 1


def test_styles_hide_what_they_say():
    page = (
        """<p style='content:"display:none"'>seen</p><div style="visibility:hidden">no<b style="visibility:visible">yes</b><br>no<img alt=no></div>"""
        """<p style="display:none!important;display:block">no</p><p style="DISPLAY : none">no</p><p style="/* display:none */color:red">comment</p>"""
        """<p style="background:url(x;display:none)">bracket</p><p style="display:none;display:block">last</p>"""
        """<table style="visibility:collapse"><tr><td>no<td style="visibility:visible">cell</table>"""
    )
    assert html_text.visible_text(page).split() == ["seen", "yes", "comment", "bracket", "last", "cell"]


def test_a_table_is_in_proportion_to_its_source():
    wide = "w " * 25_000
    rows = "".join(f"<tr><td>a{i}<td>b{i}</tr>" for i in range(1000))
    text = html_text.visible_text(f"<table><tr><td>{wide}<td>k</tr>{rows}</table>")
    assert len(text) < 80_000 and wide.strip() in text and "a7    b7" in text  # the other rows stay aligned
    for page in (
        f"<table><tr><td>{'w ' * 400_000}<td>k</tr>{rows * 10}</table>",
        "<table><tr>" + "<td rowspan=0>x" * 1000 + "</tr>" + "<tr><td>b</tr>" * 60_000 + "</table>",
        "<table><tr><td rowspan=0 colspan=100>x</tr>" + "<tr><td>b</tr>" * 60_000 + "</table>",
        "<table><tr>" + f"<td rowspan=0>{'x' * 100}" * 100 + "</tr>" + "<tr><td>b</tr>" * 60_000 + "</table>",
    ):
        assert len(html_text.visible_text(page)) <= 17 * len(page)
        assert sorted(re.sub(r"<[^>]*>|\s", "", page)) == sorted(re.sub(r"\s", "", html_text.visible_text(page)))


def test_rows_of_one_id_lose_only_their_own_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    other = " ".join(f"q{i}" for i in range(100))
    rows = [(0, "start " + passage), (1, "z " + passage), (1, "a " + other), (None, "n " + passage), (2, other)]
    out = suffix_dedup.without_repeats(docs_of(spark, [(i, t, "en", "a", 1, "x") for i, t in rows])).collect()
    assert sum(r.text.count("p7 ") for r in out) == 1 and sum(r.text.count("q7 ") for r in out) == 1
    assert {r.text.split()[0] for r in out} >= {"start", "z", "n"} and all(r.n_chars == len(r.text) for r in out if r.n_chars != 1)


NAMES = ["cuts", "worth", "id", "row", "copies", "extra", "size", "words", "gone", "doubtful", "language"]


def test_no_column_name_clashes(spark):
    """Each stage with extra columns of all names it might use itself, and some that it does not return."""
    base = small(spark).limit(60)
    more = base.select("*", *[F.lit(n).alias(f"_{n}") for n in NAMES], *[F.lit(n).alias(n) for n in ["lines", "row_id", "taken", "a.b", "doc", "_text", "_passing"]])
    extra = more.columns[len(base.columns) :]
    model = language_id.fitted(base)
    for stage in (
        lambda d: language_id.predict(d, model), ngram_join.first_of_groups, suffix_dedup.without_repeats, mixing.mixed,
        lambda d: line_quality.cleaned(d), sharding.sharded,
    ):
        want, out = stage(base), stage(more)
        assert out.columns[: len(base.columns)] == base.columns and set(extra) <= set(out.columns)
        got = out.collect()
        assert all(r[c] == more.first()[c] for r in got[:3] for c in extra)
        assert sorted(map(str, want.drop("shard", "slot").collect())) == sorted(map(str, out.select(*[c for c in want.columns if c not in ("shard", "slot")]).collect()))
