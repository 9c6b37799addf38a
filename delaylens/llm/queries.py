"""The corpus queries and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, decontaminate, embeddings, licences, lines, manifest, minhash, pages, quality, suffixes, tokenfiles
from .shared import scratch_dir, table, written

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
WORD_FILE = "word_bpe_49k.json"
BYTE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    paths = written(chat.with_paths(chat.conversations(rows)), "paths")
    return chat.report(chat.read_back(paths, written(chat.prefix_forest(paths), "forest")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.report(lines.dedup_lines(docs.select("doc_id", "text"), lines.LineIndex.build(docs)))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(encoded, ranks))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.report(decontaminate.find_hits(docs, benchmark, keep=["doc_id"]))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    tokenfiles.token_files(table(spark, sf_dir, "documents"), path, Path(public_tokenizers.path(WORD_FILE)).read_text(), end_id=1)
    return tokenfiles.report(tokenfiles.read_tokens(spark, path))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (Path(public_tokenizers.path(name)).read_bytes() for name in (BYTE_FILE, PIECE_FILE))
    return alignment.align(table(spark, sf_dir, "documents"), a.decode(), b)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def _templates_sql() -> str:
    return ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in sorted(licences.TEMPLATES.items()))


def _manifest_sql(levels: int = 6, top: int = 5) -> str:
    """The manifest's trees, a level for each pair of common tables; ``levels`` hold 16 ** 6 rows of a source, ``top`` 16 ** 5 sources."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    digest = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    bit = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end)"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: {bit}), 4294967295::bigint)"
    beside = "coalesce(array_to_string(g[1:k % 16], ''), '')", "coalesce(array_to_string(g[k % 16 + 2:], ''), '')"
    parts = [
        f"leaf as (select doc_id, coalesce('+' || source, '') as tree, {digest('text')} as leaf, case when coalesce({crc} % 5 = 0, false) then {digest(_LOWER_TEXT)} else {digest('text')} end as node from documents)",
        "placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as k, count(*) over (partition by tree) as n from leaf)",
        "l0 as (select tree, k, leaf as d, n from placed)",
        "w0 as (select doc_id, leaf, tree, k, node, '' as proof from placed)",
    ]

    def climb(node: str, group: str, walk: str, n: int) -> None:
        for i in range(n):
            parts.append(f"{group}{i} as (select tree, k // 16 as up, list(d order by k) as g from {node}{i} where n > 1 group by 1, 2)")
            parts.append(f"{node}{i + 1} as (select tree, up as k, sha256(array_to_string(g, '')) as d, count(*) over (partition by tree) as n from {group}{i})")
            parts.append(f"{walk}{i + 1} as (select w.* exclude (k, node, proof), k // 16 as k, case when g is null then node else sha256({beside[0]} || node || {beside[1]}) end as node, proof || case when g is null then '' else {beside[0]} || {beside[1]} end as proof from {walk}{i} w left join {group}{i} g on g.tree = w.tree and up = k // 16)")

    climb("l", "g", "w", levels)
    parts.append("sub as (" + " union all ".join(f"select tree, d from l{i} where n = 1" for i in range(levels + 1)) + ")")
    parts.append("u as (select tree as source, d, row_number() over (order by tree) - 1 as k, count(*) over () as n from sub)")
    parts.append("t0 as (select 'all' as tree, k, d, n from u)")
    parts.append(f"v0 as (select doc_id, leaf, u.d as subroot, 'all' as tree, u.k, node, proof from w{levels} w join u on u.source = w.tree)")
    climb("t", "h", "v", top)
    parts.append("root as (" + " union all ".join(f"select d from t{i} where n = 1" for i in range(top + 1)) + ")")
    return "with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, root.d as root, sha256(proof) as proof_sha256, node as folded_root, node = root.d as verified from v{top}, root"


_LOWER_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = "list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_BIGRAMS_SQL = "case when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end"

QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_html_text, op3_license_scan, op4_minhash_near_dedup, op5_embedding_near_dedup, op6_chat_format, op7_line_dedup, op8_suffix_dedup, op9_bpe_round_trip, op10_decontaminate, op11_token_files, op12_token_alignment, op13_merkle_manifest)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_minhash_near_dedup": f"""
with recursive w as (
  select doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), sets as (
  select distinct doc_id, s from (select doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w where len(w) > 0)
), n as (
  select doc_id, count(*) as n from sets group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2
), link as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), reach as (
  select doc_id as id, doc_id as root from documents union select l.b, r.root from reach r join link l on l.a = r.id
)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.root) as component_id, d.doc_id = min(r.root) as kept
from documents d join reach r on r.id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
""",
    "op5_embedding_near_dedup": """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null
), u as (
  select vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as e from v where list_sum(list_transform(e, lambda y: y * y)) > 0
), link as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) >= 0.95
), reach as (
  select vec_id as id, vec_id as root from embeddings union select l.b, r.root from reach r join link l on l.a = r.id
), n as (
  select a, count(*) as n from link group by a
)
select e.vec_id, coalesce(any_value(n.n), 0) as n_links, min(r.root) as component_id, e.vec_id = min(r.root) as kept
from embeddings e join reach r on r.id = e.vec_id left join n on n.a = e.vec_id group by e.vec_id
""",
    "op10_decontaminate": f"""
with d as (
  select doc_id, list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents
), b as (
  select item_id, list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark
), wanted as (
  select item_id, least(len(w), 10) as size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as win from b where len(w) > 0
), cuts as (
  select doc_id, size, unnest(range(1, len(w) - size + 2)) as k, w from d, (select distinct size from wanted) where len(w) >= size
), hits as (
  select distinct doc_id, k, c.size, item_id from cuts c join wanted t on t.size = c.size and t.win = array_to_string(w[k:k + c.size - 1], ' ')
), spots as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + size)) as p from hits) group by 1
), items as (
  select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as own from (select distinct doc_id, item_id::varchar as i from hits) group by 1
)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(own, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join spots s on s.doc_id = d.doc_id left join items i on i.doc_id = d.doc_id
""",
    "op3_license_scan": f"""
with template as (
  select licence, b from (select licence, {_BIGRAMS_SQL} as b from (select licence, {_WORDS_SQL.format('text')} as w from (values {_templates_sql()}) t(licence, text)))
), unit as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as u from documents
  union all select doc_id, text from documents where contains(text, chr(10))
), sized as (
  select doc_id, {_BIGRAMS_SQL} as b from (select doc_id, {_WORDS_SQL.format('u')} as w from unit) where len(w) > 0
), held as (
  select doc_id, licence, 2.0 * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b)) as dice
  from sized s join template t on len(s.b) between len(t.b) * 0.8 / 1.2 and len(t.b) * 1.2 / 0.8
)
select doc_id, licence, count(*) as n_units, round(max(dice), 6) as best_dice from held where dice >= 0.8 group by doc_id, licence
""",
    "op6_chat_format": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(24 + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\\', '\\\\'), '<|', '<\|')))::bigint as formatted_chars
from rows group by conv_id
""",
    "op7_line_dedup": r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents
), keyed as (
  select doc_id, n, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), many as (
  select key, min(doc_id) as first_doc from keyed where length(key) >= 10 group by key having min(doc_id) <> max(doc_id)
), marked as (
  select k.doc_id, k.n, k.line, m.key is not null and k.doc_id <> m.first_doc as dropped from keyed k left join many m on k.key = m.key
)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by n) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
""",
    "op13_merkle_manifest": _manifest_sql(),
}
