"""The registered queries of the ten operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.language import identify, remainder, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, remainder(F.col("doc_id")) != 0)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.neardup_text import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
), s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh
  from w
), e as (select doc_id, len(sh) as n, unnest(sh) as h from s), links as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.h = b.h and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(a, b) as (
  select doc_id, doc_id from s union select r.a, l.b from reach r join links l on l.a = r.b
)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, c.m as component_id
from s join (select a, min(b) as m from reach group by a) c on c.a = s.doc_id
"""


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.warc import read_bundles, write_bundles

    return read_bundles(write_bundles(table(spark, sf_dir, "pages")))


OP4_SQL = """
with p as (
  select page_id, sha1(coalesce(html, '')) as d, octet_length(encode(coalesce(html, ''))) as n from pages
), g as (
  select d, max(page_id) as kept from p where n >= 1000 group by d
)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
  case when g.kept is not null and p.page_id is distinct from g.kept then 'revisit' else 'response' end as record_type,
  case when g.kept is not null and p.page_id is distinct from g.kept then g.kept end as refers_to
from p left join g on g.d = p.d and p.n >= 1000
"""


def op5_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.neardup_vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
), u as (
  select vec_id, label, e from v
  where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98
), reach(a, b) as (
  select vec_id, vec_id from v union select r.a, l.b from reach r join links l on l.a = r.b
), c as (select a, min(b) as m from reach group by a), n as (select a, count(*) as k from links group by a)
select v.vec_id, coalesce(n.k, 0) as n_links, c.m as component_id, v.vec_id = c.m as kept
from v left join c on c.a = v.vec_id left join n on n.a = v.vec_id
"""


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as k from s)
select query_id, cast(k as integer) as rank, vec_id, score from r where k <= 5
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.mixing import copies

    took = copies(table(spark, sf_dir, "documents"))
    rows = took.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.token_files import read_files, write_files

    files, dictionary = write_files(table(spark, sf_dir, "documents"))
    return read_files(files, dictionary)


def _start() -> Column:
    """Where the dated list and the captures begin, without a time zone."""
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def _captures(pages: DataFrame) -> DataFrame:
    """Each page with a fetch time, a minute of 2024 by its page_id."""
    minute = F.pmod(F.col("page_id") * 100_003, F.lit(527_040)).cast("int")
    return pages.select("page_id", "url", (_start() + F.make_dt_interval(mins=minute)).alias("fetched_at"))


def _entries(pages: DataFrame, two_labels: bool = False) -> DataFrame:
    """A dated block and allow list over the hosts and parent domains of pages: three dated entries for each chosen key.

    Without two_labels only keys with two dots or more are chosen.
    """
    from quern.llm.url_filter import keys_of

    keys = pages.select(F.explode(keys_of(F.col("url"))).alias("key")).distinct()
    keys = keys.withColumn("h", F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long"))
    keys = keys.where((F.col("h") % 3 == 0) & (F.lit(two_labels) | F.col("key").like("%.%.%")))
    step = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step")
    rows = keys.select("key", "h", step)
    action = F.when(F.col("step") == 1, "off").when(F.col("h") % 5 == 0, "allow").otherwise("block")
    day = F.col("h") % 97 + F.col("step") * (F.lit(20) + F.col("h") % 83)
    at = _start() + F.make_dt_interval(days=day.cast("int"))
    return rows.select(F.when(F.col("h") % 2 == 0, "ads").otherwise("spam").alias("list"), "key", action.alias("action"), at.alias("at"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.url_filter import filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(_captures(pages), _entries(pages))


def op9_url_filter_site_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With two-label parents such as example.com in the list, which a large part of the captures asks for."""
    from quern.llm.url_filter import filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(_captures(pages), _entries(pages, two_labels=True))


OP9_SQL = r"""
with parts as (
  select page_id, url, timestamp '2024-01-01' + to_minutes((((page_id * 100003) % 527040) + 527040) % 527040) as fetched_at,
    rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.') as host,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) as first
  from pages
), numbered as (
  select *, row_number() over () as rid, string_split(host, '.') as labels from parts
), keys as (
  select rid, page_id, url, fetched_at, -1 as depth, host || '/' || first as key from numbered where host <> '' and first <> ''
  union all
  select rid, page_id, url, fetched_at, k as depth, array_to_string(labels[cast(k as bigint):], '.') as key
  from (select *, unnest(range(1, greatest(2, len(labels)))) as k from numbered where host <> '') t
), hashed as (
  select key, cast('0x' || substr(md5(key), 1, 6) as bigint) as h from (select distinct key from keys) t
), entries as (
  select case when h % 2 = 0 then 'ads' else 'spam' end as list, key,
    case when step = 1 then 'off' when h % 5 = 0 then 'allow' else 'block' end as action,
    timestamp '2024-01-01' + to_days(cast(h % 97 + step * (20 + h % 83) as integer)) as since
  from hashed, (values (0), (1), (2)) s(step) where h % 3 = 0 and key like '%.%.%'
), spans as (
  select list, key, action, since as valid_from, lead(since) over (partition by list, key order by since) as valid_to from entries
), hits as (
  select k.rid, k.depth, k.key, s.action, s.list, s.valid_from,
    row_number() over (partition by k.rid order by k.depth, case when s.action = 'allow' then 0 else 1 end, s.list) as r,
    count(*) over (partition by k.rid) as n
  from keys k join spans s on s.key = k.key and s.action <> 'off'
    and s.valid_from <= k.fetched_at and (s.valid_to is null or k.fetched_at < s.valid_to)
)
select p.page_id, p.url, p.fetched_at, coalesce(h.action, 'none') as verdict, h.key as matched, h.list as list,
  h.valid_from as listed_at, coalesce(h.n, 0) as n_active
from numbered p left join hits h on h.rid = p.rid and h.r = 1
"""

#: The same without the condition on dots.
OP9_SITE_WIDE_SQL = OP9_SQL.replace(" and key like '%.%.%'", "")

QUERIES = {
    "op1_language": op1_language,
    "op2_similar_documents": op2_similar_documents,
    "op3_licenses": op3_licenses,
    "op4_warc": op4_warc,
    "op5_vector_near_duplicates": op5_vector_near_duplicates,
    "op6_top_k": op6_top_k,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_url_filter": op9_url_filter,
    "op9_url_filter_site_wide": op9_url_filter_site_wide,
    "op10_token_files": op10_token_files,
}
ORACLE_SQL: dict[str, str] = {"op2_similar_documents": OP2_SQL, "op4_warc": OP4_SQL, "op5_vector_near_duplicates": OP5_SQL, "op6_top_k": OP6_SQL, "op9_url_filter": OP9_SQL, "op9_url_filter_site_wide": OP9_SITE_WIDE_SQL}
