"""One query for each operator over its whole table, and the SQL that checks it where SQL can."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hectara.llm import classifier, decontamination, mixing, near_duplicates, pseudonyms, quality_rules, records, set_join, sharding, token_counts, url_rules, vector_codes, whitening
from hectara.llm.common import table
from hectara.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


MIX_SQL = r"""
with sized as (
  select doc_id, coalesce('=' || source, '') s, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) size,
    ('0x' || md5(concat_ws('|', cast(doc_id as varchar), text))[1:15])::bigint k, coalesce(cast(doc_id as varchar), '') t
  from documents),
sources as (
  select s, sum(size)::bigint n, row_number() over (order by s = '', s) - 1 as i from sized group by s),
weighed as (
  select *, [3.0, 1.0, 2.0][(i % 3 + 1)::int]::double w, n * 2.0::double lim, (sum(n) over ())::double * 1.5::double total from sources),
levels as (
  select *, (total - coalesce(sum(lim) over b, 0)::double) / (sum(w) over () - coalesce(sum(w) over b, 0))::double lev
  from weighed window b as (order by lim / w, i rows between unbounded preceding and 1 preceding)),
targets as (
  select s, n, case when lim <= lev * w then lim else max(case when lim > lev * w then lev end) over () * w end target from levels),
budgets as (
  select *, floor(target)::bigint budget, case when n > 0 then floor(target)::bigint // n else 0 end epochs from targets),
groups as (
  select s, k, t, sum(size) g, count(*) r from sized group by s, k, t),
running as (
  select *, coalesce(sum(g) over (partition by s order by k, t rows between unbounded preceding and 1 preceding), 0) f from groups)
select d.doc_id, d.size::bigint size, b.n source_size, b.target,
  (b.epochs * d.size + case when r.f + r.g <= b.budget - b.epochs * b.n then d.size
    when r.f <= b.budget - b.epochs * b.n then least(d.size, (b.budget - b.epochs * b.n - r.f) // r.r) else 0 end)::bigint taken
from sized d join budgets b using (s) join running r on r.s = d.s and r.k = d.k and r.t = d.t
"""


@query("op1_mixing", MIX_SQL)
def op1(spark, sf_dir):
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def op2(spark, sf_dir):
    judged = quality_rules.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_token_counts")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return token_counts.with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048, keep=["doc_id"])


@query("op4_binary_records")
def op4(spark, sf_dir):
    path = f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    records.write_records(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return records.digest_records(spark, path)


LEAK_SQL = r"""
with d as (
  select row_number() over () r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
b as (
  select coalesce(cast(item_id as varchar), '') item, w from (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark) where len(w) > 0),
bw as (
  select distinct item, size, array_to_string(w[i:i + size - 1], ' ') g
  from (select item, w, least(10, len(w)) size, unnest(generate_series(1, greatest(1, len(w) - 9))) i from b)),
dw as (
  select r, i, size, array_to_string(w[i:i + size - 1], ' ') g
  from (select r, w, size, unnest(generate_series(1, len(w) - size + 1)) i from d, (select distinct size from bw) where len(w) >= size)),
hits as (select r, i, dw.size, item from dw join bw on dw.size = bw.size and dw.g = bw.g),
n as (select r, count(distinct p) n_hit from (select r, unnest(generate_series(i, i + size - 1)) p from hits) group by r),
items as (select r, count(*) n_items, string_agg(item, ',' order by item) names from (select distinct r, item from hits) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n using (r) left join items using (r)
"""


@query("op5_decontamination", LEAK_SQL)
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_items(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op6_pseudonyms")
def op6(spark, sf_dir):
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="corpus-release-1")


SHARD_BYTES = 64 << 20
SHARD_SQL = f"""
with d as (
  select doc_id, coalesce(strlen(text), 0)::bigint n_bytes, ('0x' || md5(concat_ws('|', cast(doc_id as varchar), text))[1:15])::bigint h from documents),
p as (select d.*, depth, h >> (60 - depth) prefix from d, (select unnest(generate_series(0, 60)) depth)),
b as (select depth, prefix, sum(n_bytes)::bigint shard_bytes from p group by depth, prefix having sum(n_bytes) <= {SHARD_BYTES} or min(h) = max(h)),
f as (select doc_id, n_bytes, h, min(depth) depth, arg_min(shard_bytes, depth) shard_bytes from p join b using (depth, prefix) group by doc_id, n_bytes, h)
select doc_id, n_bytes, case when depth = 0 then '' else lpad(bin(h >> (60 - depth)), depth::int, '0') end shard, depth::int depth, shard_bytes, shard_bytes > {SHARD_BYTES} oversized from f
"""


@query("op7_sharding", SHARD_SQL)
def op7(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES).drop("text")


NEAR_SQL = r"""
with recursive d as materialized (
  select row_number() over () r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) w from documents),
s as materialized (
  select distinct r, array_to_string(w[i:i + 3], ' ') g from (select r, w, unnest(generate_series(1, greatest(1, len(w) - 3))) i from d where len(w) > 0)),
n as materialized (select r, count(*) n from s group by r),
links as materialized (
  select p.a, p.b from (select x.r a, y.r b, count(*) c from s x join s y on x.g = y.g and x.r < y.r group by 1, 2) p
  join n na on na.r = p.a join n nb on nb.r = p.b where 100 * c >= 80 * (na.n + nb.n - c)),
both_ways as materialized (select a, b from links union all select b, a from links),
reach(a, b) as (select r, r from d union select reach.a, e.b from reach join both_ways e on reach.b = e.a),
least_id as (select reach.a r, min(d.doc_id) c from reach join d on d.r = reach.b group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, c component_id, c = doc_id kept from d left join n using (r) join least_id using (r)
"""


@query("op8_near_duplicates", NEAR_SQL)
def op8(spark, sf_dir):
    return near_duplicates.duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=80).drop("text_key")


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    return classifier.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URL_SQL = r"""
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages),
r(rh, rp, rv) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f as (
  select page_id, host, path, arg_max(rh || rp, length(rh || rp)) filter (rh is not null) rule, arg_max(rv, length(rh || rp)) verdict
  from p left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id, host, path)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from f
"""


@query("op10_url_rules", URL_SQL)
def op10(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


JOIN_SQL = NEAR_SQL.replace("80 *", "85 *").replace(", c = doc_id kept", "")


@query("op11_set_join", JOIN_SQL)
def op11(spark, sf_dir):
    return set_join.joined_sets(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)


CODE_SQL = r"""
with k as materialized (
  select row_number() over () r, vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
wide as (select max(len(embedding)) // 16 w from k),
x as materialized (
  select r, p, list_transform(embedding[p * w + 1:p * w + w], lambda c: floor(256 * c::double)::bigint) x from k, wide, (select unnest(range(16)) p)),
b0 as materialized (select p, e, x b from x join (select r, row_number() over (order by vec_id, embedding) - 1 e from k where vec_id is not null) using (r) where e < 64),
a0 as materialized (select r, p, x, arg_min(e, (d, e)) e from (select r, x.p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - b[i]) * (x[i] - b[i]))) d from x join b0 on x.p = b0.p) group by r, p, x),
m0 as (select p, e, list(m order by i) b from (select p, e, i, floor(sum(x[i]) / count(*))::bigint m from a0, wide, (select unnest(range(1, 65)) i) where i <= w group by p, e, i) group by p, e),
b1 as materialized (select p, e, coalesce(m0.b, b0.b) b from b0 left join m0 using (p, e)),
a1 as materialized (select r, p, x, arg_min(e, (d, e)) e from (select r, x.p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - b[i]) * (x[i] - b[i]))) d from x join b1 on x.p = b1.p) group by r, p, x),
m1 as (select p, e, list(m order by i) b from (select p, e, i, floor(sum(x[i]) / count(*))::bigint m from a1, wide, (select unnest(range(1, 65)) i) where i <= w group by p, e, i) group by p, e),
b2 as materialized (select p, e, coalesce(m1.b, b1.b) b from b1 left join m1 using (p, e)),
a2 as (select r, p, arg_min(e, (d, e)) e, min(d) d from (select r, x.p, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - b[i]) * (x[i] - b[i]))) d from x join b2 on x.p = b2.p) group by r, p),
coded as (select r, string_agg(printf('%02x', e), '' order by p) code, sum(d)::bigint error from a2 group by r),
books as (select sha256(string_agg(array_to_string(b, ','), ',' order by p, e)) codebooks_sha256 from b2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from k join coded using (r), books
"""


@query("op12_vector_codes", CODE_SQL)
def op12(spark, sf_dir):
    return vector_codes.encode(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


@query("op13_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000)
