"""Corpus operators against brute force, round trips and awkward input."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("delaylens.llm")
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from delaylens.llm import bpe, chat, decontaminate, embeddings, licences, lines, minhash, pages, quality, shared, suffixes

DOCS = "doc_id long, text string"
PATTERN = public_tokenizers.PATTERN


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(n)]
    for k in range(0, n, 4):  # near and exact copies, shared passages
        own = texts[k].split(" ")
        if len(own) > 20:
            own[rng.randrange(len(own))] = "zz"
            texts[(k * 7 + 1) % n] = " ".join(own)
        texts[(k * 5 + 2) % n] += " " + texts[k][: rng.randint(0, 200)]
    texts[3] = texts[8]
    return [(k, t) for k, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "Ünique\x00 ẞ 😀 <|im_end|> \\| it's 12² ab"), (1004, "a " * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    return shared.written(spark.createDataFrame(corpus(), DOCS), "docs")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_pack_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1])
    assert (shared.unpack(shared.pack(x)) == x).all()
    assert len(shared.unpack(shared.pack(np.array([], dtype=int)))) == 0


def test_blocks_cut_and_join():
    import pyarrow as pa

    texts = ["a" * k for k in (3, 0, 9, 1, 1, 1, 25, 2, 0, 0)]
    for size in (1, 3, 10):
        made = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + size])], names=["text"]) for k in range(0, len(texts), size)]
        got = [b.column(0).to_pylist() for b in shared.blocks(iter(made), "text", 10)]
        assert sum(got, []) == texts and all(sum(map(len, g)) <= 10 or len(g) == 1 for g in got) and len(got) <= 5


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(500, 560)] + [(None, 3), (4, 4)]
    low = {}
    for a, b in edges:
        if a is not None and a != b:
            low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(len(low)):
        for a, b in edges:
            if a in low and b in low and a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = shared.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == low
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe_equals_tiktoken(spark, docs):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(bpe.decode(bpe.encode(docs, ranks, PATTERN), ranks))
    for i, text in corpus():
        assert got[i]["token_ids"] == encoding.encode_ordinary(text or "")
        assert bytes(got[i]["decoded"]).decode() == (text or "")
    assert bpe.encode(docs.where("false"), ranks, PATTERN).count() == 0
    assert bpe.encode(docs.where("doc_id = 1000"), ranks, PATTERN).first()["token_ids"] == []


def test_splitter_agrees_with_the_slow_one():
    import regex

    slow, fast = regex.compile(PATTERN).findall, bpe.splitter(PATTERN)
    for c in [*range(0x250), 0x2028, 0x3000, 0x1F600]:
        for text in (chr(c), f"a{chr(c)}1", f" {chr(c)} ", f"'s{chr(c)}  x"):
            assert fast(text) == slow(text)


def windows(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination(spark, docs, limit):
    texts = dict(corpus())
    items = [(1, " ".join((texts[0] or "").split()[:25])), (2, "zz"), (3, None), (4, "..."), (5, texts[5].upper()), (10, " ".join(texts[5].split()[3:14]))]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.find_hits(docs.withColumn("n_hit0", F.lit(1)), items_df, max_windows=limit))
    for i, text in texts.items():
        words, hit, own = windows(text), set(), set()
        for item, t in items:
            w = windows(t)
            for s in range(max(0, len(w) - 10 + 1)) if len(w) >= 10 else ([0] if w else []):
                win = w[s : s + 10]
                for k in range(len(words) - len(win) + 1):
                    if words[k : k + len(win)] == win:
                        hit |= set(range(k, k + len(win)))
                        own.add(str(item))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["hit_items"], got[i]["hit_words"]) == (len(words), len(hit), sorted(own), sorted(hit)), i
    clash = docs.withColumn("n_hit", F.lit("x"))
    kept = decontaminate.remove_documents(clash, items_df, max_windows=limit)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == {i for i in texts if not got[i]["n_hit"]}
    cut = rows(decontaminate.remove_spans(clash, items_df, max_windows=limit))
    assert all(len(windows(cut[i]["text"])) == got[i]["n_words"] - got[i]["n_hit"] for i in texts)
    assert cut[1000]["text"] is None


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination_of_missing_and_repeated_ids(spark, limit):
    data = [(None, "say zz now", 1), (None, "clean", 0), (7, "zz zz", 2), (7, "clean words", 0), (7, "yy", 1), (8, None, 0)]
    df = spark.createDataFrame(data, DOCS + ", want int")
    items = spark.createDataFrame([(1, "zz"), (2, "yy")], "item_id long, text string")
    got = decontaminate.find_hits(df, items, max_windows=limit).collect()
    assert len(got) == len(data) and all(r["n_hit"] == r["want"] and len(r["hit_items"]) == min(r["want"], 1) for r in got)
    assert decontaminate.remove_documents(df, items, max_windows=limit).count() == 3


def near(texts, percent=85):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return sets, low


def test_minhash_equals_brute_force(spark, docs):
    base = [f"w{k}" for k in range(200)]
    rng = random.Random(2)
    more = []
    for k in range(40):  # a cluster of copies, each with edits of its own, on both sides of the threshold
        own = list(base)
        for _ in range(k // 6):
            own[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        more.append((2000 + k, " ".join(own)))
    texts = corpus() + more
    sets, low = near(texts)
    got = rows(minhash.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in texts], DOCS + ", bucket string")))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), low[i], low[i] == i) for i in sets}
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    twice = minhash.near_duplicates(spark.createDataFrame([(7, "a b c"), (7, "a b c"), (None, "a b c"), (9, "A  b\nc")], DOCS)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in twice) == [(-1, -1, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    a, b = (" ".join(f"{p}{k}" for k in range(60)) for p in "ab")
    own = [(1, a), (1, b), (2, f"{a} z"), (3, f"{b} z")]
    for data in (own, own[::-1]):  # texts of one id are told apart
        got = minhash.near_duplicates(spark.createDataFrame(data, DOCS)).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False)]


def test_similar_pairs_counts_exactly():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    i, j = minhash.similar_pairs(sets, 50)
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if 2 * len(np.intersect1d(sets[a], sets[b])) >= len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    for k in range(0, 200, 2):
        x[k + 1] = x[k] + rng.standard_normal(16) * rng.choice([0, 0.1, 0.3, 0.35])
    x[250:280] = x[0] + rng.standard_normal((30, 16)) * 0.15
    data = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [1.0] * 4), (905, [2.0] * 4), (906, [None] + [1.0] * 15)]
    got = rows(embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>")), "vec_id")
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = (y @ y.T >= 0.95) & ~np.eye(300, dtype=bool)
    low = np.arange(300)
    for _ in range(300):
        low = np.minimum(low, np.where(linked, low[None, :], 10**6).min(axis=1))
    found = sum(got[k]["n_links"] for k in range(300))
    assert found >= 0.999 * linked.sum() and all(got[k]["n_links"] <= linked[k].sum() for k in range(300))
    assert [got[k]["component_id"] for k in range(300)] == low.tolist()
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (900, 901, 902, 903, 906)) and got[905]["component_id"] == 904


def test_embeddings_of_one_id_are_told_apart(spark):
    own = [(7, [1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0]), (8, [1.0, 0.01, 0.0]), (9, [0.01, 1.0, 0.0]), (5, [0.0, 0.0, 1.0])]
    for data in (own, own[::-1]):
        got = embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(5, 0, 5, True), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 7, False)]


def test_embedding_tiles_cover_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 8)
    rng = np.random.default_rng(5)
    x = np.ones(8) + rng.standard_normal((60, 8)) * 0.01
    got = embeddings.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert all(r["n_links"] == 59 and r["component_id"] == 0 for r in got)


def test_chat_forest(spark):
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more <| \\ |>"), (2, 3, "assistant", "x<|im_end|>\\|"), (3, 0, "user", "hi"), (3, 1, "assistant", "other"), (4, 0, "us\\ner\n", None), (5, 1, "assistant", "b"), (5, 0, None, "a"), (6, 0, "user", "hi"), (6, 1, "assistant", "hello")]
    convs = chat.conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    paths = shared.written(chat.with_paths(convs), "paths")
    forest = chat.prefix_forest(paths)
    back = {r["conv_id"]: [(t["role"], t["text"], t["learnt"]) for t in r["turns"]] for r in chat.read_back(paths, forest).collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(data, key=lambda d: d[:2]):
        want[c].append((r or "", x or "", chat_learnt(r, x)))
    assert back == dict(want)
    nodes = forest.collect()
    assert len(nodes) == len({n["node"] for n in nodes}) == 8
    by = {n["node"]: n for n in nodes}
    whole = {}
    for tree in {n["tree"] for n in nodes}:
        own = sorted((n for n in nodes if n["tree"] == tree), key=lambda n: n["start"])
        assert [n["start"] for n in own] == [0, *[n["end"] for n in own[:-1]]]
        whole[tree] = "".join(n["segment"] for n in own)
    for r in paths.collect():
        said, n = "", None
        for key in r["path"]:
            n = by[key]
            assert n["position"] == len(said)
            said += n["segment"]
            seen = "".join(whole[n["tree"]][a["start"] : a["end"]] for a in n["attends"])
            assert seen == said


def chat_learnt(role, text):
    return (text or "") if role == "assistant" else ""




def kept_lines(texts, least=10):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip("\t\n\x0b\x0c\r "))
    where = defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            where[key(line)].add(i)
    out = {}
    for i, t in texts:
        own = (t or "").split("\n")
        keep = [x for x in own if not (len(key(x)) >= least and len(where[key(x)]) > 1 and i != min(where[key(x)]))]
        out[i] = (len(own), len(own) - len(keep), "\n".join(keep))
    return out


def line_docs():
    rng = random.Random(6)
    pool = [f"Shared line number {k} of them " for k in range(15)] + ["short", "", "  ÄÖ shared äö line  "]
    return [(i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice([*pool, f"own line {i} {rng.random()}"]) for _ in range(rng.randint(1, 8)))) for i in range(60)] + [(100, None), (101, "")]


def test_line_dedup_and_its_reversal(spark):
    texts = line_docs()
    df = spark.createDataFrame(texts, DOCS)
    said = lambda index, own: {i: (r["n_lines"], r["n_dropped"], r["text"] or "") for i, r in rows(lines.dedup_lines(spark.createDataFrame(own, DOCS), index)).items()}
    index = lines.LineIndex.build(df)
    assert said(index, texts) == kept_lines(texts)
    first, second = texts[:40], texts[40:]
    grown = lines.LineIndex.build(spark.createDataFrame(first, DOCS)).insert(spark.createDataFrame(second, DOCS))
    assert said(grown, texts) == kept_lines(texts)
    back = grown.delete(spark.createDataFrame([(i,) for i, _ in second], "doc_id long"))
    assert said(back, first) == kept_lines(first)
    assert lines.dedup_lines(df.where("false"), lines.LineIndex.build(df.where("false"))).count() == 0


def test_lines_of_one_hash_are_two_lines(spark):
    inv, p2, p1, low = pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B185EBCA87), np.uint64(31)
    rng, start = np.random.default_rng(1), np.uint64((42 + 0x9E3779B185EBCA87 + 0xC2B2AE3D27D4EB4F) % (1 << 64))
    turn = lambda x: ((x << low) | (x >> np.uint64(33))) * p1  # noqa: E731  a round of the hash
    first = rng.integers(97, 123, (4_000_000, 8)).astype(np.uint8).view(np.uint64).ravel()
    state = turn(start + first * p2)
    second = np.frombuffer(b"abcdefgh", np.uint64)
    other = second[0] + (state[0] - state) * np.uint64(inv)
    raw = other.view(np.uint8).reshape(-1, 8)
    fine = np.flatnonzero(((raw > 32) & (raw < 127) & ~((raw >= 65) & (raw <= 90))).all(axis=1))
    assert len(fine) > 1
    rest = "-" * 24
    a, b = (first[k : k + 1].tobytes().decode() + rest + other[k : k + 1].tobytes().decode() + rest for k in (fine[0], fine[1]))
    df = shared.written(spark.createDataFrame([(1, a), (2, b)], DOCS), "docs")
    assert a != b and df.select(F.xxhash64("text")).distinct().count() == 1
    assert {r["n_dropped"] for r in lines.dedup_lines(df, lines.LineIndex.build(df)).collect()} == {0}


def test_cuckoo_filter():
    keys = np.random.default_rng(7).integers(-(2**62), 2**62, 3000)
    f = lines.CuckooFilter.of(keys)
    assert f.maybe(keys).all() and int(keys[0]) in f
    f.delete(keys[:1500])
    assert f.maybe(keys[1500:]).all() and f.maybe(keys[:1500]).mean() < 0.01


@pytest.mark.parametrize("variants", [1000, 1, 3])
def test_repeated_passages(spark, monkeypatch, variants):
    monkeypatch.setattr(suffixes, "VARIANTS", variants)
    monkeypatch.setattr(suffixes, "PART", 512)
    monkeypatch.setattr(suffixes, "STEP", 700)
    texts = corpus(8) + [(2000, "x" * 300), (2001, "y" + "x" * 120), (2002, "é" * 100), (2003, "q" * 49)]
    shared_line = "one passage that many documents hold, of some length, goes on like this: "
    texts += [(3000 + k, f"{k * 7919:x} " * 3 + shared_line + f"{k % 5} and then {k * 104729:x} " * 2) for k in range(40)]
    got = rows(suffixes.remove_repeats(shared.written(spark.createDataFrame(texts, DOCS), "docs")))
    seen = set()
    for i, t in sorted(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        seen |= {raw[k : k + 50] for k in range(len(raw) - 49)}
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(raw), sum(gone), runs, kept), i


def test_missing_ids_stay_missing(spark):
    passage = "one passage of more than fifty bytes that is in all of these documents "
    texts = [(None, passage + "a"), (None, passage + "b"), (-5, passage + "c"), (-(1 << 62), passage + "d"), (-1, None), (7, passage + "e" + passage), (7, passage + "e" + passage)]
    df = shared.written(spark.createDataFrame(texts, DOCS), "docs")
    removed = suffixes.remove_repeats(df).collect()
    assert Counter((r["doc_id"], r["n_removed"]) for r in removed) == Counter({(None, 0): 2, (-5, 71): 1, (-(1 << 62), 0): 1, (-1, 0): 1, (7, 142): 2})
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(df, ranks, PATTERN), ranks)
    assert Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in coded.collect()) == Counter((i, t or "") for i, t in texts)
    assert suffixes.remove_repeats(df.where("false")).count() == bpe.encode(df.where("false"), ranks, PATTERN).count() == 0


def test_merged_transforms_keep_order():
    texts = [np.frombuffer(b"banana\0bandana\0", dtype=np.uint8), np.frombuffer(b"ananas\0band\0", dtype=np.uint8)]
    made = [suffixes.transform(t, 4) for t in texts]
    place, common = suffixes.merge_transforms([t for _, t in made], 4)
    block = np.cumsum(common < 4)[place]
    key = [bytes(np.take(t, range(k, k + 4), mode="wrap")) for (order, _), t in zip(made, texts) for k in order.tolist()]
    assert all((block[a] == block[b]) == (key[a] == key[b]) and (block[a] < block[b]) == (key[a] < key[b]) for a in range(len(key)) for b in range(len(key)))
    assert (common == 4).sum() == len(key) - len(set(key))


def knesser(texts, order=5):
    grams = Counter()
    for t in texts:
        raw = b"\0" * (order - 1) + t.encode()
        grams.update(raw[k : k + order] for k in range(len(raw) - order + 1))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {k: quality.discounts(tuple(sum(c == i for c in lv.values()) for i in (1, 2, 3, 4))) for k, lv in levels.items()}
    sums = {k: defaultdict(lambda: [0, 0.0]) for k in levels}
    for k, lv in levels.items():
        for g, c in lv.items():
            sums[k][g[:-1]][0] += c
            sums[k][g[:-1]][1] += cut[k][min(c, 3) - 1]

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / 256
        s, d = sums[len(g)].get(g[:-1], (0, 0))
        c = levels[len(g)].get(g, 0)
        return (max(c - (cut[len(g)][min(c, 3) - 1] if c else 0), 0) + d * lower) / s if s else lower

    def perplexity(text):
        raw = b"\0" * (order - 1) + text.encode()
        n = len(raw) - order + 1
        return math.exp(-sum(math.log(p(raw[k : k + order])) for k in range(n)) / n)

    return perplexity


def test_quality_equals_direct_kneser_ney(spark):
    texts = [(i, t, "en" if i % 2 else "de") for i, t in corpus(9)]
    df = shared.written(spark.createDataFrame(texts, DOCS + ", lang string"), "docs")
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(None,)], "doc_id long")
    got = rows(quality.classify(df, trusted))
    trains = {i for i, r in got.items() if r["role"] == "trains"}
    assert trains and all(r["role"] is None for i, r in got.items() if i >= 60 or i % 2)
    ppl = knesser([t for i, t, _ in texts if i in trains and t])
    for i, t, _ in texts:
        if t:
            assert got[i]["perplexity"] == pytest.approx(ppl(t), rel=1e-5)
        else:
            assert got[i]["perplexity"] is None and not got[i]["kept"]
    assert quality.drop_low_quality(df.where("false"), trusted).count() == 0


def test_quality_rejects_repetition(spark):
    rng = random.Random(4)
    usual = ["der", "und", *("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(150))]
    prose = lambda: " ".join(rng.choice(usual) for _ in range(80))
    texts = [(k, prose(), "de") for k in range(700)] + [(1000 + k, prose() if k % 7 else f"{k}# " + "".join(chr(rng.randrange(33, 64)) for _ in range(300)), "fr") for k in range(250)]
    texts += [(2000, "Der " * 80, "de"), (2001, "der und " * 60, "fr"), (2002, prose(), "de")]
    df = shared.written(spark.createDataFrame(texts, DOCS + ", lang string"), "docs")
    got = rows(quality.classify(df, df.where("doc_id < 2000").select("doc_id")))
    held = Counter(r["lang"] for r in got.values() if r["role"] == "held_out")
    assert held["de"] >= quality.least_trusted(0.99) == 101 > held["fr"] >= 20
    assert not got[2000]["kept"] and not got[2001]["kept"] and got[2002]["kept"]
    assert got[2001]["threshold"] < max(r["perplexity"] for r in got.values() if r["lang"] == "fr" and r["role"] == "held_out")


def test_main_text():
    page = '<html><body><header><h1>S</h1></header><nav><a href=x>home</a></nav><div class="wrap"><div class="post 12"><h2>T &amp; U</h2><p>One is long enough&nbsp;here.<p>Two <i>it</i>alic<br>next<ul><li>x<li>y</ul><script>if(a<b){"</p>"}</script><form><p>mail</p></form></div><div class="cookie-notice">c</div><section class="comments"><p>reader</p></section></div><footer>f</footer></body></html>'
    found = pages.parsed(page)
    assert found[pages.best_container(found)][0] == "html>body>div.wrap>div.#.post"
    assert pages.text_of(found, None) == "T & U\nOne is long enough here.\nTwo italic next\nx\ny"
    assert pages.text_of(pages.parsed("plain < text &lt;"), None) == "plain < text <"


def test_marks_are_read_from_whole_names():
    long = "word " * 30
    within = lambda x: f"<html><body><nav>n n</nav><article><p>{long}</p>{x}</article><div class=comments><p>c</p></div></body></html>"
    own = "A lost paragraph of some length."
    kept = ['<p title="a hidden cost">{}</p>', '<div aria-hidden="false">{}</div>', '<p data-hidden="0">{}</p>', '<p><a href="/read?id=related">{}</a></p>', '<p data-id="footer">{}</p>', '<p data-class="ad">{}</p>', "<p title='class=ad'>{}</p>", '<h2 id="privacy">{}</h2>', '<h2 id="the-first-widget">{}</h2>', '<h3 id="social">{}</h3>', '<section id="search"><p>{}</p></section>', '<section id="reply"><p>{}</p></section>', '<p class=a class=ad>{}</p>']
    for x in kept:
        assert pages.text_of(pages.parsed(within(x.format(own))), None) == f"{long.strip()}\n{own}", x
    gone = ['<div aria-hidden="true">{}</div>', "<p hidden>{}</p>", '<p hidden="hidden">{}</p>', '<p style="display: none">{}</p>', '<div class="x ad">{}</div>', "<div id=footer>{}</div>", '<section class="comments"><p>{}</p></section>', '<div role="navigation">{}</div>', "<form><p>{}</p></form>"]
    for x in gone:
        assert pages.text_of(pages.parsed(within(x.format(own))), None) == long.strip(), x
    form = f'<html><body><form id="aspnetForm"><nav>n</nav><article><p>{long}</p><form><p>mail</p></form></article><footer>f</footer></form></body></html>'
    assert pages.text_of(pages.parsed(form), None) == f"{long.strip()}\nmail"
    assert pages.text_of(pages.parsed(f"<body><div class=ads><form><p>{long}</p></form></div></body>"), None) == long.strip()


def slow_text(html):
    """What a page says, by the standard library's parser: a tree of elements, dropped ones cut out, then a line for each block."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.root = self.at = {"tag": "", "gone": False, "own": [], "up": None}

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                return self.handle_data(" ")
            known = {}
            for k, v in attrs:
                known.setdefault(k, v or "")
            marks = {"ad", "comments", "footer", "cookie-notice"}
            named = known.get("class", "") + " " + (known.get("id", "") if tag not in ("h2", "section") else "")  # ids made from titles tell nothing
            gone = tag in ("nav", "footer", "aside", "script", "style", "header", "form") or "hidden" in known or known.get("aria-hidden") == "true" or bool(marks & set(named.split()))
            new = {"tag": tag, "gone": gone, "own": [], "up": self.at}
            self.at["own"].append(new)
            self.at = new

        def handle_endtag(self, tag):
            at = self.at
            while at["up"] is not None and at["tag"] != tag:
                at = at["up"]
            if at["up"] is not None:
                self.at = at["up"]

        def handle_data(self, data):
            self.at["own"].append(data)

    tree = Tree()
    tree.feed(html)
    tree.close()
    blocks, line = [], []

    def end():
        said = " ".join("".join(line).split())
        line.clear()
        if said:
            blocks.append(said)

    def walk(node):
        for x in node["own"]:
            if isinstance(x, str):
                line.append(x)
            else:
                block = x["tag"] in ("p", "div", "ul", "li", "h2", "section", "article", "blockquote", "nav", "footer", "aside", "header", "form", "body", "html")
                if block:
                    end()
                if not x["gone"]:
                    walk(x)
                if block:
                    end()

    walk(tree.root)
    end()
    return "\n".join(blocks)


def test_main_text_of_random_trees():
    rng = random.Random(12)
    words = ["alpha", "be&amp;ta", "ga&#109;ma", "x &lt; y", "caf&eacute;", "don't", 'say "so"', "a=b"]
    extra = ["", "", ' title="hidden ad"', " class=lead", ' class="x12 post"', " id=t1", ' aria-hidden="false"', ' class="ad"', " hidden", ' id="comments"', " data-class=ad", ' aria-hidden="true"', ' alt="<b>"']

    def inline(n):
        out = []
        for _ in range(n):
            w = rng.choice(words)
            out.append(rng.choice([w, w, f"<b>{w}</b>", f"<i{rng.choice(extra[:4])}>{w}</i>", f"{w}<br>", f"{w}\n\t "]))
        return " ".join(out)

    def tree(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if depth == 0 or kind < 0.5:
                tag = rng.choice(["p", "h2", "p"])
                out.append(f"<{tag}{rng.choice(extra)}>{inline(rng.randint(1, 8))}</{tag}>")
            elif kind < 0.6:
                out.append(f"<{(t := rng.choice(['nav', 'footer', 'aside', 'script', 'form']))}>{'var a = 1' if t == 'script' else inline(1)}</{t}>")
            elif kind < 0.7:
                out.append("<ul>" + "".join(f"<li>{inline(2)}</li>" for _ in range(rng.randint(1, 3))) + "</ul>")
            else:
                tag = rng.choice(["div", "section", "blockquote"])
                out.append(f"<{tag}{rng.choice(extra)}>{tree(depth - 1)}</{tag}>")
        return "\n".join(out)

    for _ in range(400):  # the article is told by its tag and a long paragraph, so that all of its text is wanted
        html = f"<html><body><header>h</header><article><p>{'plain words ' * 40}</p>{tree(3)}<p>{'more words ' * 40}</p></article><footer>f</footer></body></html>"
        assert pages.text_of(pages.parsed(html), None) == slow_text(html), html


def test_pages_with_maps_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_KEYS", 1)
    df = spark.range(300).select((F.col("id") * 0).alias("page_id"), F.lit("http://h.example/").alias("url"), F.lit("<p>one text</p>").alias("html"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    got = pages.extract(df).collect()
    assert len(got) == 300 and {(r["text"], r["m"]["a"]) for r in got} == {("one text", 1)}


def test_consensus_rules_the_host(spark):
    page = lambda body: f"<html><body><nav>n n n</nav>{body}<footer>f</footer></body></html>"
    long = "word " * 40
    data = [(k, "http://A.example/x", page(f"<div class='c{k}'><p>{long}{k}</p></div><div class='more'><p>see</p></div>")) for k in range(4)]
    data += [(9, "http://a.example:80/y", page(f"<div class='c7'><p>short text</p></div><div class='more'><p>{long}</p></div>")), (10, None, None), (11, "nonsense", ""), (12, "http://b.example/", page("<p>only</p>"))]
    got = rows(pages.extract(spark.createDataFrame(data, "page_id long, url string, html string")), "page_id")
    assert got[9]["text"] == "short text" and got[0]["text"] == (long + "0").strip() and got[10]["text"] == got[11]["text"] == "" and got[12]["text"] == "only"


def test_article_keeps_what_stands_round_its_largest_container(spark):
    page = lambda body: f"<html><body><nav>n n n</nav>{body}<footer>f</footer></body></html>"
    long, links = "word " * 40, "<div class='x'>" + "<a href=y>see this other one</a> " * 5 + "</div>"
    bodies = [
        f"<article><h1>Title</h1><p>lead</p><div class=body><p>{long}</p></div><p>close</p></article>",
        f"<div class=post><h1>Title</h1><p>lead</p><section><p>{long}</p></section><p>close</p></div>{links}",
        f"<main><div class=top><h1>Title</h1><p>lead</p></div><div class=body><p>{long}</p></div><p>close</p></main>{links}",
        f"<h1>Title</h1><p>lead</p><blockquote>{long}</blockquote><p>close</p>",
    ]
    whole = "\n".join(["Title", "lead", long.strip(), "close"])
    data = [(k, f"http://h{k}.example/", page(b)) for k, b in enumerate(bodies)]
    data += [(k, "http://many.example/", page(f"<article><div class=body><p>{long}</p></div></article>")) for k in (10, 11, 12)]
    data += [(13, "http://many.example/", page(bodies[0])), (14, "http://many.example/", page(f"<article> </article><div class=z><p>{long}</p></div>"))]
    data += [(15, "http://l.example/", page(f"<main>{links}<div class=body><p>short</p><p>{long}</p></div></main>"))]
    got = rows(pages.extract(spark.createDataFrame(data, "page_id long, url string, html string")), "page_id")
    assert [got[k]["text"] for k in range(4)] == [whole] * 4 and got[13]["text"] == whole
    assert got[10]["text"] == got[14]["text"] == long.strip() and got[15]["text"] == "short\n" + long.strip()


def test_main_text_of_ordinary_attributes_and_names(spark):
    body = lambda x: f"<html><body><nav>n n</nav><article><p>{'word ' * 30}</p>{x}</article></body></html>"
    data = [
        (1, body("<p title=don't>One two</p><p>Three it's <b>four</b></p>"), "One two\nThree it's four"),
        (2, body('<p class="share-price">Price</p><div id="notice-of-motion"><p>Motion</p></div><p title="a > b">x</p>'), "Price\nMotion\nx"),
        (3, body('<div class="cookie-notice">c</div><div class="share-buttons">s</div><div class="related-posts"><p>r</p></div><div id=\'comments\'>q</div><p>end</p>'), "end"),
    ]
    data = [(k, f"http://p{k}.example/", h, w) for k, h, w in data]
    df = spark.createDataFrame([d[:3] for d in data], "page_id long, url string, html string").withColumns({"_path": F.lit(1), "host": F.lit("h"), "n": F.lit(2), "_key": F.lit(3), "text": F.lit("t")})
    out = pages.extract(df.unionByName(df))
    got = out.collect()
    assert len(got) == 2 * len(data) and all(r["text"] == ("word " * 30).strip() + "\n" + data[r["page_id"] - 1][3] and (r["_path"], r["host"], r["n"], r["_key"]) == (1, "h", 2, 3) for r in got)
    assert pages.extract(df.where("false")).count() == 0


def test_chat_of_missing_ids_and_other_columns(spark):
    ddl = "conv_id long, turn long, role string, text string, node string, n int, rank int"
    data = [(None, 0, "user", "a", "x", 1, 1), (None, 1, "assistant", "b", "x", 1, 1), (2, 0, "user", "a", "x", 1, 1), (2, 0, "user", "a", "x", 1, 1)]
    df = spark.createDataFrame(data, ddl)

    def said(rows):
        paths = shared.written(chat.with_paths(chat.conversations(rows)), "paths")
        return {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.read_back(paths, chat.prefix_forest(paths)).collect()}

    assert said(df) == {None: ["a", "b"], 2: ["a", "a"]} and said(df.where("false")) == {}


def test_embeddings_of_extreme_sizes(spark):
    data = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [-1e200, 1e200]), (4, [-1e200, 1e200]), (None, [1.0, 1.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"t": F.lit(1), "key": F.lit(2), "copies": F.lit(3)}))
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1) for r in got.collect()) == [(-1, 0, -1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (4, 1, 4)]
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_KEYS", 1)
    left = spark.range(1000).select((F.col("id") % 3 * F.col("id") % 7).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = shared.spread_join(left, right, ["k"], "n", 1000)
    assert sorted(map(tuple, got.select("k", "id", "top").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "id", "top").collect()))
    hub = spark.createDataFrame([(0, k) for k in range(1, 400)] + [(k, k + 1000) for k in range(1, 400, 3)], "a long, b long")
    assert {r["component"] for r in shared.connected_components(hub).collect()} == {0}


def test_lines_of_repeated_ids_and_clashing_names(spark):
    line = "a line that is long enough"
    df = spark.createDataFrame([(1, line), (1, f"x\n{line}"), (2, f"{line.upper()} \ny"), (None, line)], DOCS).withColumns({"n_lines": F.lit("z"), "k1": F.lit(1), "refs": F.lit(2)})
    out = lines.dedup_lines(df, lines.LineIndex.build(df))
    assert out.columns.count("n_lines") == 1
    assert sorted((r["doc_id"] or -1, r["text"], r["n_dropped"]) for r in out.collect()) == [(-1, line, 0), (1, line, 0), (1, f"x\n{line}", 0), (2, "y", 1)]


def test_a_window_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_KEYS", 1)
    monkeypatch.setattr(decontaminate, "CUT", 7)
    notice = " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([(k, f"start {k} {notice} end") for k in range(300)] + [(300, "zz top"), (301, None)], DOCS)
    items = spark.createDataFrame([(1, notice), (2, "zz")], "item_id long, text string")
    got = {n: sorted(map(tuple, decontaminate.report(decontaminate.find_hits(df, items, max_windows=n, keep=["doc_id"])).collect())) for n in (0, 10**6)}
    assert got[0] == got[10**6] and sum(r[2] for r in got[0]) == 300 * 12 + 1


def test_many_repeated_lines_in_one_text(spark):
    import time

    text = "\n".join(f"a repeated line number {k}" for k in range(160_000))
    df = shared.written(spark.createDataFrame([(1, text), (2, text + "\nits own last line"), (3, "short")], DOCS), "docs")
    began = time.time()
    got = {r["doc_id"]: r for r in lines.dedup_lines(df, lines.LineIndex.build(df)).collect()}
    assert time.time() - began < 60
    assert (got[1]["n_dropped"], got[2]["n_dropped"], got[2]["n_lines"], got[2]["text"], got[1]["text"] == text) == (0, 160_000, 160_001, "its own last line", True)


def test_quality_of_repeated_and_missing_ids(spark):
    rng = random.Random(11)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60))
    texts = [(k, prose(), "de") for k in range(700)] + [(5, prose(), "en"), (None, prose(), "de"), (-1, "#?! " * 60, "de"), (None, "#?! " * 60, None)]
    df = shared.written(spark.createDataFrame(texts, DOCS + ", lang string").withColumns({"role": F.lit(1), "kept": F.lit(2)}), "docs")
    trusted = df.where("doc_id < 700 and doc_id >= 0").select("doc_id").distinct()
    got = quality.classify(df, trusted).collect()
    assert len(got) == len(texts) and sorted(r["lang"] for r in got if r["doc_id"] == 5) == ["de", "en"]
    assert sorted(r["kept"] for r in got if r["doc_id"] is None) == [False, True] and [r["kept"] for r in got if r["doc_id"] == -1] == [False]
    kept = quality.drop_low_quality(df, trusted)
    assert kept.columns == df.columns and sorted(map(tuple, kept.where("doc_id is null or doc_id < 0").collect())) == [(None, texts[701][1], "de", 1, 2)]
    monkey = quality.MAX_BROADCAST_IDS
    quality.MAX_BROADCAST_IDS = 0
    try:
        assert quality.drop_low_quality(df, trusted).count() == kept.count()
    finally:
        quality.MAX_BROADCAST_IDS = monkey


def test_licences_equal_brute_force(spark):
    import re

    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    grams = lambda w: {" ".join(p) for p in zip(w, w[1:])} if len(w) > 1 else set(w)
    mit = licences.TEMPLATES["mit"]
    half = len(mit) // 2
    texts = [(1, "Prose.\nReleased under the MIT license\nmore"), (2, mit), (3, mit[:half] + "\n" + mit[half:]), (4, None), (5, ""), (6, "licensed"), (7, "Licensed under the apache license version 2.0, see there"), (8, "x\nReleased under the MIT License.\nreleased UNDER the mit license!")]
    want = {}
    for i, t in texts:
        own = (t or "").split("\n")
        for unit in own + ([t] if len(own) > 1 else []):
            a = grams(cut(unit))
            for name, template in licences.TEMPLATES.items():
                b = grams(cut(template))
                if a and (d := 2 * len(a & b) / (len(a) + len(b))) >= 0.8:
                    n, best = want.get((i, name), (0, 0))
                    want[i, name] = (n + 1, max(best, round(d, 6)))
    got = licences.scan(spark.createDataFrame(texts, DOCS)).collect()
    assert {(r["doc_id"], r["licence"]): (r["n_units"], r["best_dice"]) for r in got} == want and (3, "mit") in want


def test_licences_inside_other_text(spark):
    import textwrap

    rng = random.Random(5)
    prose = " ".join(f"p{rng.randrange(400)}" for _ in range(900))
    wrapped = lambda name: "\n".join(" * " + x for x in textwrap.wrap(licences.TEMPLATES[name], 60))
    whole = ("mit", "bsd-2-clause", "bsd-3-clause", "isc", "gpl-3.0", "gpl-2.0", "apache-2.0", "mpl-2.0")
    texts = [(k, f"{prose}\n/*\n{wrapped(name)}\n */\n{prose}") for k, name in enumerate(whole)]
    texts += [(20, "This document is Released under the MIT License."), (21, "As you may well know by now it is released under the MIT license and so on"), (22, prose), (23, f"{prose} the license of this software is not known {prose}"), (24, f"{prose}\n{wrapped('bsd-2-clause/1')}\n{prose}")]
    got = defaultdict(dict)
    for r in licences.scan(spark.createDataFrame(texts, DOCS)).collect():
        got[r["doc_id"]][r["licence"]] = r["best_dice"]
        assert r["n_units"] == 1
    for k, name in enumerate(whole):
        assert got[k][name] == 1.0 and max(d for x, d in got[k].items() if "/" not in x and x != "apache-2.0-line") == 1.0, name
    assert got[20] == got[21] == {"mit-line": 1.0} and 22 not in got and 23 not in got and got[24]["bsd-2-clause/1"] == 1.0


def test_licences_complete_texts(spark):
    assert licences.TEMPLATES["mit"].endswith("OTHER DEALINGS IN THE SOFTWARE.")
    whole = [" ".join(p) for p in licences.PARAGRAPHS.values()]
    assert all(t.count("LIABLE") == 1 for t in whole)
    texts = [(k, t) for k, t in enumerate(whole)] + [(9, "Licensed under CC BY-SA 4.0")]
    got = {(r["doc_id"], r["licence"]): r["best_dice"] for r in licences.scan(spark.createDataFrame(texts, DOCS)).collect()}
    assert all(got[k, name] == 1.0 for k, name in enumerate(licences.PARAGRAPHS)) and got[9, "cc-by-sa-4.0-line"] == 1.0


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = [(i, (t or "") + ("\nA line that is everywhere" if i % 2 else ""), "en", "s", len(t or "")) for i, t in corpus(10)]
    spark.createDataFrame(texts, DOCS + ", lang string, source string, n_chars long").withColumn("n_lines", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts[5][1].split()[:12]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = shared.written(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        if k < 4:
            assert out.columns == docs.columns
        docs = out
        sizes.append(docs.count())
    assert sizes[1] <= sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] <= sizes[3] and sizes[5] == sizes[4]
    assert "n_tokens" in docs.columns


def test_pipeline_links_from_four_fifths(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    base = [f"w{k}" for k in range(204)]
    texts = [(1, " ".join(base)), (2, " ".join([*base[:50], "x", *base[51:100], "y", *base[101:150], "z", *base[151:200], *base[200:]]))]
    texts += [(3, " ".join([*base[:182], *[f"v{k}" for k in range(22)]])), (4, " ".join([*base[:170], *[f"u{k}" for k in range(34)]]))]
    sets, _ = near(texts)
    alike = lambda i: len(sets[1] & sets[i]) / len(sets[1] | sets[i])
    assert alike(2) >= 0.85 and 0.8 <= alike(3) < 0.85 and alike(4) < 0.8
    kept = pipeline.near_duplicate_stage(spark, shared.written(spark.createDataFrame(texts, DOCS), "docs"), "")
    assert {r["doc_id"] for r in kept.collect()} == {1, 4}


def piped(texts, good, items):
    """Documents as (doc_id, text, lang) through all five stages, by direct means: (doc_id, token ids)."""
    from struct import pack
    from xxhash import xxh64_intdigest

    held = {i for i in good if (lambda h: h - (h >> 63 << 64))(xxh64_intdigest(pack("<q", i), seed=42)) % 5 == 0}
    ppl = knesser([t for i, t, _ in texts if i in good - held and t])

    def left(t):
        import zlib

        raw, n = t.encode(), 0
        for k in range(0, len(raw), 2048):
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            n += len(c.compress(raw[k : k + 2048]) + c.flush())
        return n / len(raw)

    seen = [(ppl(t), left(t)) for i, t, _ in texts if i in held and t]
    at = lambda values, q: sorted(values)[max(0, math.ceil(q * len(values) - 1e-9) - 1)]
    high, low = at([p for p, _ in seen], 0.99), at([d for _, d in seen], 0.01)
    stage = [(i, t) for i, t, _ in texts if t and ppl(t) <= high * (1 + 1e-6) and left(t) >= low]
    sizes = [len(texts), len(stage)]
    own = kept_lines([(i, t) for i, t in stage if i is not None])
    stage = [(i, t if i is None else own[i][2]) for i, t in stage]
    sizes.append(sum(n for _, n, _ in own.values()))
    _, first = near([(i, t) for i, t in stage if i is not None], 80)
    stage = [(i, t) for i, t in stage if i is None or first[i] == i]
    sizes.append(len(stage))
    bad = []
    for t in items:
        w = windows(t)
        bad += [w[k : k + 10] for k in range(max(1, len(w) - 9))] if w else []
    holds = lambda w, b: any(w[k : k + len(b)] == b for k in range(len(w) - len(b) + 1))
    stage = [(i, t) for i, t in stage if not any(holds(windows(t), b) for b in bad)]
    sizes.append(len(stage))
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    return sizes, Counter((i, tuple(encoding.encode_ordinary(t)), t) for i, t in stage)


def test_pipeline_equals_brute_force(spark, tmp_path):
    from hashlib import sha256

    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    usual = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(usual) for _ in range(n))
    shared_line = "A line that many of the documents repeat"
    texts = [(k, "\n".join([prose(rng.randint(15, 60)), prose(20), *([shared_line] if k % 3 == 0 else [])]), "de" if k % 2 else "en") for k in range(80)]
    for k in range(0, 24, 4):  # near copies on one line, longer than any edit, and exact copies
        words = prose(150).split(" ")
        texts.append((200 + k, " ".join(words), "en"))
        words[k * 5] = "zz"
        texts.append((201 + k, " ".join(words) + "\n" + prose(5), "en"))
        texts.append((202 + k, texts[-2][1] if k % 8 else texts[-2][1] + " " + prose(60), "fr"))
    items = [" ".join(texts[10][1].split()[2:14]), None, texts[81][1][:400], "nowhere else"]
    texts += [(300, "?#9 " * 60, "en"), (301, usual[0] + (" " + usual[0]) * 90, "de"), (302, None, "en"), (303, "", None), (304, " \n\t", "en"), (None, prose(50), "fr")]
    texts += [texts[7], texts[7], (305, prose(3000), "en"), (306, shared_line, "en")]
    good = {i for i, _, _ in texts if i is not None and i < 300 and i % 7}
    made = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.char_length("text").cast("long")})
    made.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in sorted(good)] + [(300, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes, want = piped(texts, good, items)
    assert sizes[1] < sizes[0] and sizes[2] and sizes[4] < sizes[3] < sizes[1]  # each stage has something to do
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], tuple(r["token_ids"]), r["n_tokens"], r["decoded_sha256"]) for r in got) == Counter({(i, ids, len(ids), sha256(t.encode()).hexdigest()): n for (i, ids, t), n in want.items()})
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").where("false").write.parquet(f"{empty}/{name}.parquet")
    assert pipeline.run(spark, str(empty)).count() == 0
