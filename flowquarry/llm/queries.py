"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm import ann, hardneg, html, langid, license, merkle, packing, quality, simhash, spiece, substring, tokencount, warc
from flowquarry.llm.stage import settled, shared_dir

#: Fixed value: the end id of op4's contract.
END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(table(spark, sf_dir, "documents"), stored=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    index = warc.merge(warc.read_runs(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), END_ID)
    small = parts.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.assign(settled(small))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "threshold")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.encode_decode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license.license_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.audit(docs, F.crc32(docs["doc_id"].cast("string")) % 3 == 0, bytes.lower)  # of bytes, A-Z alone


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(rows["vec_id"] % 7 == 0, F.pmod(rows["label"] + 1, F.lit(10))).otherwise(rows["label"])
    return hardneg.hard_negatives(rows, label, F.col("id") % 100 == 0)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_main_text": op2_main_text,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_nearest": op9_nearest,
    "op10_licenses": op10_licenses,
    "op11_merkle": op11_merkle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_language": op13_language,
}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
win as (select r, i, array_to_string(w[i : i + 34], ' ') as s from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
marks as (select r, i from win where s in (select s from win group by s having count(*) > 1)),
gone as (select r, list(distinct p) as ps from (select r, unnest(range(i, i + 35)) as p from marks) group by r),
cut as (select doc_id, w, case when ps is null then w else list_filter(w, lambda x, i: not list_contains(ps, i)) end as kept from d left join gone using (r))
select doc_id, len(w) as n_words, len(w) - len(kept) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from cut
"""

_BASE32 = (
    "array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    "((('0x' || substr(hex, (5 * j) // 4 + 1, 2))::int >> (3 - (5 * j) % 4)::int) & 31) + 1, 1)), '')"
)
WARC_SQL = f"""
with p as (select page_id, coalesce(html, '') as body, sha1(encode(coalesce(html, ''))) as hex from pages),
q as (select *, max(page_id) over (partition by body) as best from p)
select page_id, octet_length(encode(body)) as payload_bytes, {_BASE32} as payload_digest,
  case when best = page_id then 'response' else 'revisit' end as record_type, case when best <> page_id then best end as refers_to from q
"""


def _template_pattern(markup: str) -> str:
    """A template as a regular expression over words that each follow a blank."""
    out = []
    for mark, many, word in re.findall(r"(\[\[|\]\])|\{\{(\d+)\}\}|([^\s\[\]{}]+)", markup):
        out.append("(?:" if mark == "[[" else ")?" if mark else f"(?: [^ ]+){{0,{many}}}" if many else f" {word}")
    return "".join(out) + " "


def _phrase_places(phrase: str) -> str:
    own = phrase.split()
    test = " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(own))
    return f"list_filter(range(1, len(w) + 1), lambda i: {test})"


def _license_sql() -> str:
    places = {label: _phrase_places(p) for p, label in license.PHRASES.items()}
    base = ", ".join(f"case when len({x}) > 0 then '{label}' end" for label, x in places.items())
    found = ", ".join(f"case when regexp_matches(t, '{_template_pattern(m)}') then '{label}' end" for label, _, m in license.TEMPLATES)
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    tidy = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda y: y is not null))), ',')"
    return f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {letters}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
e as (select *, ' ' || array_to_string(w, ' ') || ' ' as t, {' || '.join(f'({x})' for x in places.values())} as places from d),
f as (select *, [{base}] as base, [{found}] as found from e)
select doc_id, len(w) as n_words, len(places) as n_base, list_min(places) - 1 as first_word, list_max(places) - 1 as last_word, {tidy('base')} as base_labels,
  {tidy('base || found')} as labels, case when len(list_filter(found, lambda y: y is not null)) > 0 then 1.0::double when len(places) > 0 then 0.5::double else 0.0::double end as score from f
"""


_field = lambda c: f"coalesce(strlen(({c})::varchar)::varchar || ':' || ({c})::varchar, '-')"
_leaf = lambda text: "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
_CRC32 = (
    "xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint), "
    "lambda acc, b: list_reduce(range(8), lambda r, k: xor(r >> 1, 3988292384::ubigint * (r & 1))::ubigint, xor(acc, b)::ubigint), 4294967295::ubigint), 4294967295::ubigint)"
)
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _merkle_levels(name: str, rows: str) -> str:
    """All levels of the trees over rows (g, i, n, h): every 8 consecutive nodes of a group become one."""
    return (
        f"{name} as (select g, 0 as l, i, n, h from ({rows}) union all "
        f"select g, l + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' order by i)) from {name} where n > 1 group by g, l, i // 8)"
    )


MERKLE_SQL = f"""
with recursive d as (
  select row_number() over () as r, doc_id, {_leaf("text")} as leaf, case when {_CRC32} % 3 = 0 then {_leaf(_LOWER)} else {_leaf("text")} end as other,
    coalesce('1' || lang, '0') as g from documents),
ranked as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from d),
{_merkle_levels("lv", "select g, i, n, leaf as h from ranked")},
sub as (select g, h as subroot, row_number() over (order by g) - 1 as i, count(*) over () as n from lv where n = 1),
{_merkle_levels("top", "select '' as g, i, n, subroot as h from sub")},
levels as (select g, max(l) as height from lv group by g),
sides as (
  select r.r, s.l, string_agg(s.h, '' order by s.i) filter (s.i < a) as before, string_agg(s.h, '' order by s.i) filter (s.i > a) as after
  from (select r, g, l, i // (8 ** l)::bigint as a from ranked join levels using (g), lateral (select unnest(range(0, height)) as l)) r join lv s on s.g = r.g and s.l = r.l and s.i // 8 = r.a // 8
  group by r.r, s.l, a
  union all
  select r.r, 1000 + s.l, string_agg(s.h, '' order by s.i) filter (s.i < a), string_agg(s.h, '' order by s.i) filter (s.i > a)
  from (select r, l, sub.i // (8 ** l)::bigint as a from ranked join sub using (g), (select unnest(range(0, (select max(l) from top))) as l)) r join top s on s.l = r.l and s.i // 8 = r.a // 8
  group by r.r, s.l, a),
paths as (select r, list({{'b': coalesce(before, ''), 'a': coalesce(after, '')}} order by l) as path from sides group by r)
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.b || x.a), ''), '')) as proof_sha256,
  coalesce(list_reduce(list_transform(path, lambda x: [x.b, x.a]), lambda acc, x: [sha256(x[1] || acc[1] || x[2])], [other])[1], other) as folded_root, folded_root = root as verified
from ranked join sub using (g) left join paths using (r), (select h as root from top where n = 1)
"""

HARD_NEGATIVES_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select a.vec_id as anchor_id, a.label, c.vec_id as other_id, c.label as other_label, list_sum(list_transform(list_zip(a.q, c.q), lambda z: z[1] * z[2]))::bigint as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
pos as (select anchor_id, other_id as positive_id, score as positive_score from p where label = other_label qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank, other_id as negative_id, positive_score, score as negative_score
from pos join p using (anchor_id) where label <> other_label and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other_id) <= 10
"""

#: The others tokenise, hash with XXH64, fit a score, search a graph or read markup; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": SUBSTRING_SQL, "op3_warc": WARC_SQL, "op10_licenses": _license_sql(), "op11_merkle": MERKLE_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
