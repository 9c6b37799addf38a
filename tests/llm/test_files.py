"""Token files, token alignment and the dataset manifest against brute force and awkward input."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("delaylens.llm")
import public_tokenizers
from pyspark.sql import functions as F

from delaylens.llm import alignment, manifest, shared, tokenfiles

WORD = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
BYTE = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
PIECE = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()

# letters, marks that join the letter before, white space of every kind, controls, other scripts, special strings
PARTS = ["a", "B", "the ", " The", "é", "é", "́", " ̸", "≠", " ", " ", "　", "\x1c", "\x85", "\t", "\n", " ", "  ", "\r\n", "Σ", "ΟΔΟΣ", "ß", "İ", "12", "½", "漢字", "한", "😀", "'s", "'LL", "!?", "<|endoftext|>", "<|startoftext|>", "<s>", "<0x41>", "▁", "\u0000", "_", "-", "​"]


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    return [None, "", " ", "\n", *plain, *odd_texts(1, 120), plain[0], plain[0], "word " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3 % 1009, t, "x") for k, t in enumerate(texts())] + [(None, "no id here", "y"), (7, None, None)]
    return shared.written(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), "docs")


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_str(WORD), tokenfiles.WordIds(WORD, np.dtype("<u2"))
    rng = random.Random(9)
    letters = "abcdefgrstlmvABCLLDE'.,-!|>_0123456789éñüßÀÿŐžĸ×÷"
    plain = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(40)) for _ in range(300)]
    words.learn_all(plain)
    for t in [*plain, *odd_texts(2, 3000), *(t for t in texts() if t)]:
        assert np.frombuffer(words.encode(t), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_stretches_lose_only_the_cuts():
    text = "ab  c\nd e f " * 50
    got = list(shared.stretches(text, 7))
    assert " ".join(got) == text and len(got) > 20


def test_token_files(spark, docs, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfiles, "SEGMENT_BYTES", 300)
    path = f"file://{tmp_path}/tokens"
    tokenfiles.token_files(docs, path, WORD, end_id=1)
    got = tokenfiles.report(tokenfiles.read_tokens(spark, path)).collect()
    whole, want = Tokenizer.from_str(WORD), []
    for r in docs.collect():
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(want)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *[r["n_tokens"] for r in ordered[:-1]]]).tolist()
    assert [r["doc_id"] for r in ordered] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i or 0))
    segments = spark.read.parquet(f"{path}/segments")
    assert segments.count() > 5 and segments.select("dictionary").distinct().count() == 1
    some = tokenfiles.read_tokens(spark, path, [3, 9, 10**9]).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in tokenfiles.read_tokens(spark, path).where("doc_id in (3, 9)").collect()) and some


def test_token_files_of_little(spark, docs, tmp_path):
    for k, own in enumerate((docs.where("false"), docs.where("text is null"))):
        path = f"file://{tmp_path}/{k}"
        tokenfiles.token_files(own, path, WORD, end_id=1)
        got = tokenfiles.read_tokens(spark, path).collect()
        assert [r["n_tokens"] for r in got] == [1] * own.count()


def test_a_wrong_dictionary_is_an_error(spark, docs, tmp_path):
    paths = [f"file://{tmp_path}/{k}" for k in "ab"]
    for path, own in zip(paths, (docs, docs.where("doc_id > 500"))):
        tokenfiles.token_files(own, path, WORD)
    spark.read.parquet(f"{paths[1]}/dictionary").write.mode("overwrite").parquet(f"file://{tmp_path}/c")
    spark.read.parquet(f"file://{tmp_path}/c").write.mode("overwrite").parquet(f"{paths[0]}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        tokenfiles.read_tokens(spark, paths[0]).collect()


def test_merges_equal_the_library():
    made, rng = alignment.Pieces(BYTE, PIECE), random.Random(8)
    letters = "abcdefghijklmnoprstuwABCDE'.,-!<|>_0123456789éñüßÀÿŐžĸ×÷"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(20_000)] + ["don't", "we'LL", "<|endoftext|>", "I'm", "x's"]
    assert made.fast and all(made.fast(f" {w}") == e.ids for w, e in zip(words, made.a.encode_batch_fast([f" {w}" for w in words], add_special_tokens=False)))
    for t in odd_texts(6, 2000):
        assert alignment.parts_of(t) == shared.GAP.split(t)


def direct_alignment(rows):
    """By whole texts, tokens as bytes, dictionaries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_str(BYTE), sentencepiece.SentencePieceProcessor(model_proto=PIECE)
    a.encode_special_tokens = True
    back = {v: k for k, v in alignment.byte_level().items()}
    assert len(back) == 256
    to_byte, made, total = alignment.byte_level(), [], Counter()
    for doc, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        left = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in x]
        right = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
        if b"".join(left) != b"".join(right) or b"".join(left) != (" " + (text or "")).encode():
            x, y, left, right = [], [], [], []
        ends = [dict(zip(np.cumsum([len(t) for t in side]).tolist(), range(len(side)))) for side in (left, right)]
        common = sorted(ends[0].keys() & ends[1].keys())
        links = [(x[ends[0][e]], y[ends[1][e]]) for e in common]
        groups, i, j = [], 0, 0
        for e in common:
            p, q = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            i, j = p, q
        made.append((doc, len(x), len(y), links, ";".join(groups)))
        total.update(links)
    most = Counter()
    for (_, q), n in total.items():
        most[q] = max(most[q], n)
    return [(d, n, m, len(links), len(links), sum(total[k] == most[k[1]] for k in links), sum(total[k] for k in links), sha256(g.encode()).hexdigest() if n else "") for d, n, m, links, g in made]


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, docs, monkeypatch, small):
    if small:  # many runs and pages, merges that pass on early
        for name, value in (("RUN_BYTES", 500), ("PAGE", 5), ("HELD", 40)):
            monkeypatch.setattr(alignment, name, value)
    got = alignment.align(docs, BYTE, PIECE)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(direct_alignment([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert alignment.align(docs.where("false"), BYTE, PIECE).count() == 0


def direct_manifest(rows):
    H = lambda parts: sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([H(levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
        return levels

    def way(levels, k):
        out = []
        for level in levels[:-1]:
            run = k // 16 * 16
            out.append((level[run : run + 16], k - run))
            k //= 16
        return out

    by = {}
    for doc, source, lang, n, text in rows:
        leaf, other = (H(map(field, (doc, source, lang, n, t))) for t in (text, low(text)))
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        by.setdefault(source, []).append(((doc is not None, doc or 0), leaf, other if hit else leaf, doc))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by[s], key=lambda x: x[:2]) for s in order}
    trees = {s: tree([x[1] for x in own[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for k, (_, leaf, changed, doc) in enumerate(own[s]):
            path = way(trees[s], k) + way(top, j)
            node = changed
            for run, at in path:
                node = H([*run[:at], node, *run[at + 1 :]])
            proof = H(x for run, at in path for m, x in enumerate(run) if m != at)
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("hot, sources", [(0, 1), (1, 1), (17, 3), (700, 40), (70_000, 300)])
def test_manifest(spark, hot, sources):
    rng = random.Random(hot)
    rows = [(k, "hot", rng.choice(["en", None]), rng.choice([None, 12]), f"Text {k}") for k in range(hot)] + [(10**6 + k, rng.choice([None, "", "é", f"s{k % sources}"]), "de", 3, rng.choice([None, "", "UPPER", "lower"])) for k in range(2 * sources)]
    rows += [(None, "hot", None, None, None), (5, "hot", "en", 1, "again"), (5, "hot", "en", 1, "again")]
    rng.shuffle(rows)
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA).withColumn("root", F.lit(1)))
    assert Counter(map(tuple, got.collect())) == Counter(direct_manifest(rows))


def test_manifest_of_nothing_and_of_one_row(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert manifest.manifest(empty).count() == 0
    (row,) = manifest.manifest(spark.createDataFrame([(4, None, None, None, None)], SCHEMA)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == sha256(b"1:4----").hexdigest() and row["verified"] and row["proof_sha256"] == sha256(b"").hexdigest()


def test_subtree_sweeps():
    nodes = [sha256(str(k).encode()).hexdigest() for k in range(200)]
    (top,), _ = manifest._up(nodes, 2)
    for k, way in enumerate(manifest._down(nodes, 2, "")):
        assert manifest.fold(nodes[k], way, [(k, 200)]) == top
