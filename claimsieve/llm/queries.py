"""Registered queries of the training-data operators and, where SQL can express them, their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.llm import bond, chat, decontaminate, html_crf, jaccard, kdtree, merkle, mixing, pairwise, quality_rules, token_pack, toxicity, warc
from claimsieve.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP5 = f"""
with dw as (select doc_id, {_ALNUM.format('text')} as w from documents),
iw as (select item_id, {_ALNUM.format('text')} as w from benchmark),
win as (select distinct item_id, least(len(w), 10) as size, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') as g
        from (select item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) as i from iw where len(w) > 0)),
sizes as (select distinct size from win),
dwin as (select doc_id, i, size, array_to_string(w[i + 1 : i + size], ' ') as g
         from (select doc_id, w, size, unnest(range(0, len(w) - size + 1)) as i from dw, sizes where len(w) >= size)),
hits as (select d.doc_id, d.i, d.size, item_id from dwin d join win using (size, g)),
marked as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as names
          from (select distinct doc_id, item_id::varchar as s from hits) group by doc_id)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join marked using (doc_id) left join found using (doc_id)
"""


@query("op5_decontamination", _OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 10-word phrases of every benchmark item in every document, from the positional index."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: F.coalesce(x.cast("string"), F.lit("null"))))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


_GROUPS = f"""
w as (select doc_id, {_SPACED.format(_LOWER.format('text'))} as w from docs),
sh as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
              else list_transform(range(0, len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) end) as s from w),
tok as (select doc_id, unnest(s) as g from sh),
few as (select g from tok group by g having count(*) > 1),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from tok a join few using (g) join tok b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select x, y from pairs join sh p on p.doc_id = x join sh q on q.doc_id = y where 100 * c >= 85 * (len(p.s) + len(q.s) - c)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select x, y from both_ways union select r.x, e.y from reach r join both_ways e on r.y = e.x),
least as (select x as doc_id, min(y) as m from reach group by x),
grouped as (select sh.doc_id, len(s)::bigint as n_shingles, coalesce(least(m, sh.doc_id), sh.doc_id) as component_id from sh left join least using (doc_id))
"""
_OP7 = f"with recursive docs as (select doc_id, text from documents), {_GROUPS} select doc_id, n_shingles, component_id from grouped"


@query("op7_ngram_jaccard", _OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 4-word shingle sets are 85 % alike."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


@query("op1_toxicity_chain")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the labelled categories and of toxicity for every document.

    ``labels`` names two properties; the chain predicts low quality first, then toxicity, which may use it."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"])


@query("op2_token_pack")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed ids of all documents, written and read back."""
    import public_tokenizers

    return token_pack.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50_257)


_OP3 = r"""
with m as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v),
e as (select *, length(replace(replace(text, '\', '\\'), '<', '\l')) + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), chr(10), '\n')) as n from m)
select conv_id::bigint as conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(n + length('<|turn ' || '|>' || '<|end|>') + 2)::bigint as formatted_chars
from e group by conv_id
"""


@query("op3_chat_format", _OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like control strings, formatted, written and read back."""
    trap = "\\### Assistant: </turn> ok"
    given = table(spark, sf_dir, "conversations")
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("m"))
    extra = extra.select("conv_id", "m.turn", "m.role", F.lit(trap).alias("text"))
    out = materialize(chat.format_conversations(given.select("conv_id", "turn", "role", "text").unionByName(extra)), "chat")
    turns = F.concat_ws("", F.transform(chat.parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))))
    back = out.select("conv_id", "formatted", turns.alias("turns"), F.size(chat.parse(F.col("formatted"))).cast("long").alias("n_turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return back.select(
        "conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the field trained on this table's sample."""
    pages = table(spark, sf_dir, "pages")
    return html_crf.extract_pages(pages, html_crf.fit_field(pages))


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base check and the verdict of the learned list for every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry scores of every document, learned outside the held-out third."""
    return pairwise.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling rate and draw of every document for the source, language and topic targets."""
    docs = table(spark, sf_dir, "documents").withColumn("_form", mixing.form_topic())
    cells = materialize(mixing.cells_of(docs, ["source", *mixing.TARGETS], mixing.estimated_tokens()), "cells")
    targets = {"source": mixing.source_targets(cells)} | mixing.TARGETS
    return mixing.mix(docs, targets, cells, most=None).select("doc_id", "source", "lang", F.col("_form").alias("topic"), F.round("sample_rate", 9).alias("sample_rate"), "copies")


_OP10 = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha1(h) as x, first_value(page_id) over (partition by h order by page_id) as f from p),
b as (select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (('0x' || substr(x, (i // 4) * 5 + 1, 5))::bigint // (32 ** (3 - i % 4))::bigint) % 32, 1)), '') as payload_digest from d)
select page_id, payload_bytes, payload_digest, case when f = page_id then 'response' else 'revisit' end as record_type,
       case when f <> page_id then f end as refers_to from b
"""


@query("op10_warc", _OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through the index."""
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _scaled(scale: int, label: str = "label") -> str:
    """Usable rows ``r, vec_id, label, v`` in SQL."""
    return f"""select row_number() over () as r, vec_id, {label} as label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v
        from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0"""


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))::bigint"

_OP11 = f"""
with e as ({_scaled(256, 'case when vec_id % 7 = 0 then (label + 1) % 10 else label end')} and label is not null),
s as (select a.r as a, a.vec_id as anchor_id, b.r as b, b.vec_id as other, a.label = b.label as same, {_DOT.format('a.v', 'b.v')} as score
      from e a, e b where a.vec_id % 100 = 0 and a.r <> b.r),
p as (select * from s where same qualify row_number() over (partition by a order by score desc, other) <= 5),
n as (select p.anchor_id, p.other as positive_id, p.score as positive_score, s.other as negative_id, s.score as negative_score,
             row_number() over (partition by p.a, p.b order by s.score desc, s.other) as k
      from p join s on s.a = p.a and not s.same and 100 * s.score between 30 * p.score and 90 * p.score)
select anchor_id, positive_id, k::int as rank, negative_id, positive_score, negative_score from n where k <= 10
"""


@query("op11_hard_negatives", _OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score 30 to 90 % of each anchor's five positives; every seventh label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.hard_negatives(table(spark, sf_dir, "embeddings"), label)


_OP12 = f"""
with e as ({_scaled(1024)}),
s as (select a.r as a, a.vec_id as query_id, b.vec_id, {_DOT.format('a.v', 'b.v')} as score from e a, e b where a.vec_id % 100 = 0 and a.r <> b.r)
select query_id, (row_number() over (partition by a order by score desc, vec_id))::int as rank, vec_id, score from s
qualify row_number() over (partition by a order by score desc, vec_id) <= 10
"""


@query("op12_kdtree_topk", _OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows with the highest inner product for every hundredth id."""
    return kdtree.top_k(table(spark, sf_dir, "embeddings"))


_CODE = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_CODE.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_CRC32 = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, len({0}) + 1), lambda i: ascii({0}[i])::bigint)),
    lambda acc, c: list_reduce(list_concat([xor(acc, c)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda a, _: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)), 4294967295)"""

_OP13 = f"""
with recursive d as (select doc_id, coalesce('=' || lang, '') as run, {_LEAF.format(n='n_chars')} as leaf,
                            case when {_CRC32.format('(doc_id::varchar)')} % 7 = 0 then {_LEAF.format(n='(n_chars + 1)')} end as told from documents),
placed as (select *, row_number() over (partition by run order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by run) as n from d),
low as (select run, 0 as l, pos as p, leaf as h, n from placed
        union all select run, l + 1, p // 2, sha256(string_agg(h, '' order by p)), (any_value(n) + 1) // 2 from low where n > 1 group by run, l, p // 2),
tops as (select run, h as subroot, row_number() over (order by run) - 1 as pos, count(*) over () as n from low where n = 1),
high as (select 0 as l, pos as p, subroot as h, n from tops
         union all select l + 1, p // 2, sha256(string_agg(h, '' order by p)), (any_value(n) + 1) // 2 from high where n > 1 group by l, p // 2),
fold as (select x.doc_id, x.run, x.pos as id, coalesce(x.told, x.leaf) as h, '' as proof, x.pos as p, 0 as l from placed x
         union all
         select f.doc_id, f.run, f.id, sha256(case when f.p % 2 = 1 then coalesce(s.h, '') || f.h else f.h || coalesce(s.h, '') end), f.proof || coalesce(s.h, ''), f.p // 2, f.l + 1
         from fold f join low o on o.run = f.run and o.l = f.l and o.p = f.p and o.n > 1 left join low s on s.run = f.run and s.l = f.l and s.p = xor(f.p, 1)),
ends as (select * from fold qualify l = max(l) over (partition by run, id)),
climb as (select e.run, e.id, e.h, e.proof, t.pos as p, 0 as l from ends e join tops t using (run)
          union all
          select c.run, c.id, sha256(case when c.p % 2 = 1 then coalesce(s.h, '') || c.h else c.h || coalesce(s.h, '') end), c.proof || coalesce(s.h, ''), c.p // 2, c.l + 1
          from climb c join high o on o.l = c.l and o.p = c.p and o.n > 1 left join high s on s.l = c.l and s.p = xor(c.p, 1)),
last as (select * from climb qualify l = max(l) over (partition by run, id)),
root as (select h as root from high where n = 1)
select x.doc_id, x.leaf, t.subroot, root.root, sha256(last.proof) as proof_sha256, last.h as folded_root, last.h = root.root as verified
from placed x join tops t using (run) join last on last.run = x.run and last.id = x.pos cross join root
"""


@query("op13_merkle_manifest", _OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; every seventh checksum's document claims one character more."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    claimed = [F.when(tampered, c + 1).otherwise(c) if i == 3 else c for i, c in enumerate(columns)]
    return merkle.manifest(table(spark, sf_dir, "documents"), F.col("lang"), "doc_id", columns, claimed)
