"""Queries over the text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsieve.catalog.registry import register
from claimsieve.operators import textjobs as X
from claimsieve.session import materialize
from claimsieve.sources.claims import table

PAIRS = [("$", "USD "), ("&amp;", "&"), ("  ", " "), ("http://", "https://"), ("```", "'''"), ("USD  ", "USD "), ("\\le", "≤")]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replaced_sql() -> str:
    ctes = ["t0 as (select doc_id, text from documents)"]
    for i, (old, new) in enumerate(PAIRS):
        hits = ", ".join([f"h{j}" for j in range(i)] + [f"contains(text, {quoted(old)})::int as h{i}"])
        ctes.append(f"t{i + 1} as (select doc_id, replace(text, {quoted(old)}, {quoted(new)}) as text, {hits} from t{i})")
    return "with " + ",\n".join(ctes)


LAST = f"t{len(PAIRS)}"


@register("dictionary_replace", f"{_replaced_sql()} select doc_id, length(text) as n_chars, md5(text) as text_md5 from {LAST}")
def dictionary_replace(spark, sf_dir):
    out = X.dictionary_replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PAIRS)
    return out.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@register(
    "dictionary_hits",
    _replaced_sql()
    + " "
    + " union all ".join(
        f"select {i} as entry, {quoted(old)} as old, cast(sum(h{i}) as bigint) as n_documents, sum(h{i}) = 0 as never_hit from {LAST}"
        for i, (old, _) in enumerate(PAIRS)
    ),
)
def dictionary_hits(spark, sf_dir):
    return X.dictionary_hits(X.dictionary_replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PAIRS), PAIRS)


REPORTED = [("the", "The"), ("The", "the"), ("e ", "e  "), ("zzzz", "z"), ("  ", " "), ("of", "of the")]


def _report_sql() -> str:
    ctes = ["t0 as (select doc_id, text from documents)"]
    for i, (old, new) in enumerate(REPORTED):
        hits = ", ".join([f"h{j}" for j in range(i)] + [f"contains(text, {quoted(old)})::int as h{i}"])
        ctes.append(f"t{i + 1} as (select doc_id, replace(text, {quoted(old)}, {quoted(new)}) as text, {hits} from t{i})")
    counts = " union all ".join(
        f"select {i} as entry, {quoted(old)} as old, coalesce(sum(h{i}), 0)::bigint as n_documents, "
        f"count(*) filter (where contains(text, {quoted(old)})) as n_still_present from t{len(REPORTED)}"
        for i, (old, _) in enumerate(REPORTED)
    )
    return (
        "with " + ",\n".join(ctes) + f" select *, n_documents = 0 as never_hit, case when n_still_present > 0 then 'still present' "
        f"when n_documents = 0 then 'never hit' end as problem from ({counts})"
    )


@register("replacement_report", _report_sql())
def replacement_report(spark, sf_dir):
    """Entries that undo each other, one that isn't there, and one whose replacement holds it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.replacement_report(materialize(X.dictionary_replace(docs, REPORTED), "replaced"), REPORTED)


@register(
    "residual_audit",
    r"""select doc_id, len(l)::int as n_lines, len(list_filter(l, lambda x: regexp_matches(x, '\$')))::int as pattern_0,
  len(list_filter(l, lambda x: regexp_matches(x, '\\[a-zA-Z]+')))::int as pattern_1,
  len(list_filter(l, lambda x: contains(x, 'begin{')))::int as pattern_2,
  len(list_filter(l, lambda x: regexp_matches(x, '\$|\\[a-zA-Z]+') or contains(x, 'begin{')))::int as n_residual
from (select doc_id, string_split(text, chr(10)) as l from documents)""",
)
def residual_audit(spark, sf_dir):
    return X.residual_audit(table(spark, sf_dir, "documents"))


# Every document as a short Markdown report that carries its whole text.
REPORT = r"""concat('# ', source, '\n\n- lang: ', lang, '\n* chars: ', n_chars, '\n---\n| id | chars |\n|:--|--:|\n| ', doc_id,
  ' | ', n_chars, ' |\n\n| lone bar\n12. early item\n## Body ##\n', text, '\n\n## Tail\n', repeat('filler\n', 12), '21. late item\n2021. year\n### End')"""

def reports(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(REPORT).alias("text"))


def _report_cte() -> str:
    nl = "chr(10)"
    parts = [
        "'# '", "source", nl, nl, "'- lang: '", "lang", nl, "'* chars: '", "n_chars", nl, "'---'", nl, "'| id | chars |'", nl,
        "'|:--|--:|'", nl, "'| '", "doc_id", "' | '", "n_chars", "' |'", nl, nl, "'| lone bar'", nl, "'12. early item'", nl,
        "'## Body ##'", nl, "text", nl, nl, "'## Tail'", nl, f"repeat('filler' || {nl}, 12)", "'21. late item'", nl,
        "'2021. year'", nl, "'### End'",
    ]
    return "reports as (select doc_id, " + " || ".join(parts) + " as text from documents)"


BLOCKS_SQL = r"""
raw as (select doc_id, unnest(l) as x, unnest(range(len(l))) as line_no from (select doc_id, string_split(text, chr(10)) as l from reports)),
ln as (select doc_id, line_no, regexp_replace(x, '^\s+|\s+$', '', 'g') as x from raw),
nb as (select *, coalesce(starts_with(lag(x) over w, '|'), false) or coalesce(starts_with(lead(x) over w, '|'), false) as near
  from ln window w as (partition by doc_id order by line_no)),
kinds as (select doc_id, line_no, x, case when x = '' then 'blank' when regexp_full_match(x, '-{3,}|_{3,}|\*{3,}') then 'rule'
  when starts_with(x, '|') and near then 'table' when regexp_matches(x, '^#{1,4}\s+') then 'heading'
  when regexp_matches(x, '^[-*]\s+') then 'bullet' when regexp_matches(x, '^\d{1,2}[.．]\s+') then 'ordered'
  else 'paragraph' end as kind from nb),
blocks as (select doc_id, cast(line_no as int) as line_no, kind,
  case when kind = 'heading' then cast(length(regexp_extract(x, '^(#+)', 1)) as int) end as level,
  case kind when 'heading' then regexp_replace(x, '^#{1,4}\s+', '') when 'bullet' then regexp_replace(x, '^[-*]\s+', '')
    when 'ordered' then regexp_replace(x, '^\d{1,2}[.．]\s+', '') else x end as content from kinds)"""


@register("markdown_blocks", f"with {_report_cte()}, {BLOCKS_SQL} select * from blocks")
def markdown_blocks(spark, sf_dir):
    return X.markdown_blocks(reports(spark, sf_dir))


@register(
    "pipe_table_cells",
    f"with {_report_cte()}, {BLOCKS_SQL}"
    + r""",
split as (select doc_id, line_no, list_transform(string_split(regexp_replace(content, '^\|+|\|+$', '', 'g'), '|'), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')) as cells
  from blocks where kind = 'table')
select doc_id, line_no, cast(unnest(range(len(cells))) as int) as col, unnest(cells) as cell from split
where len(list_filter(cells, lambda c: not (c = '' or regexp_full_match(c, ':?-{2,}:?')))) > 0""",
)
def pipe_table_cells(spark, sf_dir):
    return X.pipe_table_cells(X.markdown_blocks(reports(spark, sf_dir)))


@register(
    "section_extract",
    f"with {_report_cte()}"
    + r""",
raw as (select doc_id, unnest(l) as x, unnest(range(len(l))) as i from (select doc_id, string_split(text, chr(10)) as l from reports)),
first as (select doc_id, min(i) as s from raw where starts_with(x, '## Body') group by doc_id),
stop as (select r.doc_id, min(i) as e from raw r join first f using (doc_id) where i > s and starts_with(x, '## ') group by r.doc_id)
select doc_id, md5(regexp_replace(string_agg(x, chr(10) order by i), '^\s+|\s+$', '', 'g')) as section_md5, count(*) as n_lines_raw
from raw join first using (doc_id) left join stop using (doc_id) where i >= s and i < coalesce(e, 1e9) group by doc_id""",
)
def section_extract(spark, sf_dir):
    sections = X.section_extract(reports(spark, sf_dir).withColumn("original", F.col("text")), "## Body", keep=("doc_id", "original"))
    body = F.regexp_count(F.regexp_extract("original", r"(?s)(## Body.*?)\n## ", 1), F.lit("\n")) + 1
    return sections.select("doc_id", F.md5("section").alias("section_md5"), body.cast("bigint").alias("n_lines_raw"))


STATUS = "case o_orderstatus when 'F' then 'DONE' when 'P' then 'IN_PROGRESS' else 'PENDING' end"


@register(
    "stage_progress",
    f"""with st as (select o_custkey as doc_id, o_orderkey as line_no, 'A' || o_orderkey || ' ' || o_orderpriority as name, {STATUS} as status
    from orders),
agg as (select doc_id, count(*) filter (where status = 'DONE') as n_done, count(*) filter (where status = 'IN_PROGRESS') as n_doing,
    count(*) filter (where status = 'PENDING') as n_pending,
    cast(round_even(sum(case status when 'DONE' then 1.0::double when 'IN_PROGRESS' then 0.5::double else 0.0::double end) * 100 / count(*), 0) as int) as pct,
    coalesce(arg_min(name, line_no) filter (where status = 'IN_PROGRESS'), arg_max(name, line_no) filter (where status = 'DONE')) as current
    from st group by doc_id)
select * from agg""",
)
def stage_progress(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    line = F.concat(
        F.lit("| A"), F.col("o_orderkey"), F.lit(" | "), F.col("o_orderpriority"), F.lit(" |  "), F.expr(STATUS), F.lit(" | order "),
        F.col("o_orderkey"), F.lit(" |"),
    )
    status_lines = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), line.alias("line"))
    return X.stage_progress(X.parse_stages(status_lines))
