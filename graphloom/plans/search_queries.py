"""Retrieval, propagation, fusion and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import stats
from graphloom.functions.text import STOP, code_identifiers, skeleton, subtokens, identifiers, term_counts
from graphloom.operators import evaluation, fusion, graph, history, retrieval
from graphloom.plans.history_queries import LAYERS, alive, mixed_rows, pairs, static_rows
from graphloom.plans.registry import query
from graphloom.sources.tables import Model

_STOPS = ", ".join(f"'{w}'" for w in STOP)
_PARTS = r"string_split(lower(regexp_replace(regexp_replace(replace(ident, '_', ' '), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' ')"
_SUB = f"case when list_contains({_PARTS}, lower(ident)) then {_PARTS} else list_append({_PARTS}, lower(ident)) end"
_OK = f"length(term) > 1 and term not in ({_STOPS})"
_IDENTS = "unnest(regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]*')) as ident"

TF = (
    f"idents as (select file, ident, count(*) as n from (select file, {_IDENTS.format('substr(text, 1, 480000)')} from texts) group by 1, 2)",
    f"allterms as (select file, term, sum(n)::bigint as f from (select file, n, unnest({_SUB}) as term from idents) where {_OK} group by 1, 2)",
    "tf as (select file, term, f from (select *, row_number() over (partition by file order by f desc, term) as r from allterms) where r <= 2000)",
)
TERMS = f"terms as (select distinct qid, term from (select qid, unnest({_SUB}) as term from (select qid, {_IDENTS.format('text')} from issues)) where {_OK})"
BM = (
    *TF,
    TERMS,
    "dl as (select file, greatest(sum(f), 1)::double as dl from tf group by file)",
    "df as (select term, count(*) as df from tf group by term)",
    "corpus as (select count(*) as n, avg(dl) as mean from dl)",
    "bmall as (select qid, file, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))), 6) as score from tf join terms using (term) join df using (term) join dl using (file), corpus group by 1, 2)",
    "bm as (select * from (select *, row_number() over (partition by qid order by score desc, file) as rank from bmall) where rank <= 100)",
)
NAMES = "names as (select file, lower(source) as name from (select doc_id as file, source from documents))"
_CODE = f"""select distinct qid, ident from (select qid, {_IDENTS.format('text')} from issues) where length(ident) >= 3 and lower(ident) not in ({_STOPS}) and (contains(ident, '_') or (ident <> upper(ident) and ident <> lower(ident)))"""
_QUOTE = "[`''\"]([A-Za-z_][A-Za-z0-9_./]{2,})[`''\"]"
GR = (
    NAMES,
    f"asked as ({_CODE} union select qid, regexp_replace(list_extract(string_split(q, '/'), -1), '\\.py$', '') from (select qid, unnest(regexp_extract_all(text, '{_QUOTE}', 1)) as q from issues))",
    f"held as (select distinct file, ident from (select file, {_IDENTS.format('text')} from texts) where ident in (select ident from asked))",
    "idf as (select ident, ln((select count(*) from texts) / (1 + count(*))) as idf from held group by ident)",
    "gfound as (select qid, file, sum(idf) as s from asked join held using (ident) join idf using (ident) group by 1, 2)",
    "gbonus as (select g.qid, g.file, count(*) as k from gfound g join names n using (file) join asked a on a.qid = g.qid and (contains(n.name, lower(a.ident)) or contains(lower(a.ident), n.name)) group by 1, 2)",
    "gall as (select qid, file, round(s + 2.0 * coalesce(k, 0), 6) as score from gfound left join gbonus using (qid, file))",
    "gr as (select * from (select *, row_number() over (partition by qid order by score desc, file) as rank from gall) where rank <= 100)",
)
REC = (
    "recall as (select file, round(sum(exp(-age / 90.0)), 6) as score, max(ts) as last from alive group by file)",
    "rectop as (select file, score, row_number() over (order by score desc, last desc, file) as rank from recall qualify rank <= 100)",
    "rec as (select qid, file, score, rank from issues, rectop)",
)
LISTS = (
    *BM,
    *GR,
    *REC,
    "lists as (select qid, 'bm' as list, 0 as ord, rank, file, score from bm union all select qid, 'gr', 1, rank, file, score from gr union all select qid, 'rec', 4, rank, file, score from rec)",
)


def tf(m: Model):
    return term_counts(m.texts, "file")


def bm(m: Model):
    """The first hundred of each query, kept: whatever of a plan needs them reads the same rows."""
    return m.kept("bm", lambda: retrieval.bm25_texts(retrieval.query_terms(m.issues), m.texts))


def named_texts(m: Model):
    return m.table("documents").select(F.col("doc_id").alias("file"), "text", F.lower("source").alias("name"))


def gr(m: Model):
    return m.kept("gr", lambda: retrieval.identifier_search(m.issues, named_texts(m)))


def rec(m: Model):
    """The recency list is one for all queries: 100 files, so it meets every query by broadcast."""
    live = history.priors(alive(m)).withColumn("score", F.round("recency", 6))
    top = live.orderBy(F.desc("score"), F.desc("last"), "file").limit(100)
    one = graph.ranked(top.select(F.lit(0).alias("all"), "file", "score", (-F.unix_timestamp(F.col("last").cast("timestamp"))).alias("older")).withColumnRenamed("all", "qid"), 100, "older")
    return m.issues.select("qid").join(F.broadcast(one.drop("qid", "older")))


def lists(m: Model):
    return fusion.list_table({"bm": bm(m), "gr": gr(m), "rec": rec(m)})


def paths(m: Model):
    return m.files.select("file", "path", "dir")


# ---------------------------------------------------------------- text


@query("tokenize_tf", "select file, term, f from tf", *TF)
def tokenize(m):
    return tf(m)


@query("subtokens", f"select distinct ident, array_to_string({_SUB}, ' ') as parts from (select {_IDENTS.format('html')} from pages)")
def split_names(m):
    named = m.table("pages").select(F.explode(identifiers(F.col("html"))).alias("ident")).distinct()
    return named.select("ident", F.array_join(subtokens(F.col("ident")), " ").alias("parts"))


@query("issue_identifiers", "select qid, ident from asked", *GR)
def asked_names(m):
    return m.issues.select("qid", F.explode(code_identifiers(F.col("text"))).alias("ident")).distinct()


@query("bm25_query", "select qid, file, score, rank from bm", *BM)
def bm25(m):
    return bm(m)


@query("grep_idf", "select qid, file, score, rank from gr", *GR)
def grep(m):
    return gr(m)


PART_ISSUES = "asks as (select file as qid, 'Crash in ' || name || ' of ' || dir as text from files where p_size > 25)"


@query(
    "path_token",
    "select qid, file, score, rank from (select *, row_number() over (partition by qid order by score desc, file) as rank from (select qid, file, round(count(*) / (1 + ln(1.0 + n)), 6) as score from ptoks join aterms using (term) group by qid, file, n)) where rank <= 60",
    PART_ISSUES,
    f"aterms as (select distinct qid, term from (select qid, unnest({_SUB}) as term from (select qid, {_IDENTS.format('text')} from asks)) where {_OK})",
    f"ptok as (select distinct file, term from (select file, unnest({_SUB}) as term from (select file, translate(path, '/.', '__') as ident from tree)) where {_OK})",
    "ptoks as (select *, count(*) over (partition by file) as n from ptok)",
)
def path_token(m):
    asks = m.files.filter("p_size > 25").select(F.col("file").alias("qid"), F.concat(F.lit("Crash in "), "name", F.lit(" of "), "dir").alias("text"))
    return retrieval.path_tokens(retrieval.query_terms(asks), m.tree)


@query(
    "quoted_path",
    "select a.file as qid, b.file, 1::bigint as rank from files a join tree b on b.file = a.file - 1",
)
def quoted(m):
    """Each file's issue names the file before it, without its folders."""
    before = m.files.select((F.col("file") + 1).alias("qid"), F.element_at(F.split("path", "/"), -1).alias("said"))
    asks = m.files.select(F.col("file").alias("qid")).join(before, "qid").select("qid", F.concat(F.lit("see ./"), "said", F.lit(" please")).alias("text"))
    return retrieval.quoted_paths(asks, m.tree)


@query(
    "rm3_terms",
    "select qid, term, weight from (select *, row_number() over (partition by qid order by weight desc, term) as r from (select qid, term, sum(f)::bigint as weight from bm join (select *, row_number() over (partition by file order by f desc, term) as k from tf) using (file) where rank <= 5 and k <= 30 group by 1, 2)) where r <= 25",
    *BM,
)
def rm3(m):
    return retrieval.feedback_terms(bm(m), retrieval.counts_of_first(bm(m), m.texts))


@query("skeleton", r"select page_id, left(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), 500) as line from pages where contains(html, '<title>')")
def outline(m):
    """Title as docstring: the page's title stands between triple quotes."""
    quoted_title = F.concat(F.lit('"""'), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit('"""'))
    return m.table("pages").filter(F.col("html").contains("<title>")).select("page_id", skeleton(quoted_title).alias("line"))


# ---------------------------------------------------------------- propagation

SEEDS = "seeds as (select qid, file as node, score / case when sum(score) over (partition by qid) = 0 then 1 else sum(score) over (partition by qid) end as s from bm where rank <= 20)"


def _steps(n: int, rows: str = "rows", seeds: str = "seeds") -> tuple[str, ...]:
    out = [f"p0 as (select qid, node, s as p from {seeds})"]
    for k in range(1, n + 1):
        out.append(
            f"p{k} as materialized (select qid, node, sum(p) as p from (select p.qid, coalesce(r.dst, p.node) as node, 0.5 * p.p * coalesce(r.w, 1) as p from p{k - 1} p left join {rows} r on r.src = p.node where p.p > 0 union all select qid, node, 0.5 * s from {seeds}) group by 1, 2)"
        )
    return tuple(out)


def propagated(m: Model, steps: int):
    return graph.ppr(mixed_rows(m).persist(), graph.seed_vector(bm(m)), steps=steps)


@query("seed_vector", "select qid, node, round(s, 8) as s from seeds", *BM, SEEDS)
def seeds(m):
    return graph.seed_vector(bm(m)).withColumn("s", F.round("s", 8))


for _n in (1, 3, 10):

    @query(f"ppr_{_n}", f"select qid, node, round(p, 8) as p from p{_n}", *LAYERS, *BM, SEEDS, *_steps(_n))
    def ppr(m, n=_n):
        return propagated(m, n).withColumn("p", F.round("p", 8))


HYBRID = (
    "hs as (select qid, file, score / case when first_value(score) over (partition by qid order by rank) = 0 then 1 else first_value(score) over (partition by qid order by rank) end as s from bm)",
    "hp as (select qid, node as file, p / max(p) over (partition by qid) as p from p3)",
    "hyb as (select * from (select *, row_number() over (partition by qid order by score desc, file) as rank from (select qid, file, round(0.5 * coalesce(s, 0) + 0.5 * coalesce(p, 0), 8) as score from hs full join hp using (qid, file)) where score > 0) where rank <= 100)",
)


@query("hybrid_rank", "select qid, file, score, rank from hyb", *LAYERS, *BM, SEEDS, *_steps(3), *HYBRID)
def hybrid(m):
    return graph.hybrid_rank(bm(m), propagated(m, 3), top=100)


def _impact(m: Model, rows):
    focus = m.gold.select("file").distinct().join(m.tree.select("file"), "file", "left_semi")
    start = focus.select(F.col("file").alias("qid"), F.col("file").alias("node"), F.lit(1.0).alias("s"))
    p = graph.ppr(rows.persist(), start, steps=3)
    most = p.groupBy("qid").agg(F.max("p").alias("most"))
    scored = p.join(most, "qid").filter("qid <> node").select("qid", F.col("node").alias("file"), F.round(F.col("p") / F.col("most"), 8).alias("score")).filter("score > 0")
    return graph.ranked(scored, 20)


for _name, _alpha, _rows in (("static", 1.0, "srows"), ("temporal", 0.0, "trows"), ("hybrid", 0.25, "rows")):

    @query(
        f"impact_{_name}",
        "select qid, file, score, rank from (select *, row_number() over (partition by qid order by score desc, file) as rank from (select qid, file, score from (select qid, node as file, round(p / max(p) over (partition by qid), 8) as score from p3) where qid <> file and score > 0)) where rank <= 20",
        *LAYERS,
        "seeds as (select distinct file as qid, file as node, 1.0::double as s from gold where file in (select file from tree))",
        *_steps(3, _rows),
    )
    def impact(m, alpha=_alpha):
        return _impact(m, mixed_rows(m, alpha))


@query(
    "impact_freq",
    "select qid, file, freq as score, row_number() over (partition by qid order by freq desc, last desc, file) as rank from (select distinct file as qid from gold where file in (select file from tree)), (select file, count(*) as freq, max(ts) as last from alive group by file order by freq desc, last desc, file limit 21) where file <> qid qualify rank <= 20",
)
def impact_freq(m):
    """The most often changed files, for any file: one list of 21 that every query leaves itself out of."""
    from pyspark.sql import Window as W

    focus = m.gold.select(F.col("file").alias("qid")).distinct().join(m.tree.select(F.col("file").alias("qid")), "qid", "left_semi")
    top = history.priors(alive(m)).orderBy(F.desc("freq"), F.desc("last"), "file").limit(21)
    met = focus.join(F.broadcast(top)).filter("file <> qid")
    w = W.partitionBy("qid").orderBy(F.desc("freq"), F.desc("last"), "file")
    return met.withColumn("rank", F.row_number().over(w)).filter("rank <= 20").select("qid", "file", F.col("freq").alias("score"), "rank")


# ---------------------------------------------------------------- fusion


def _fused(k: int, weight: str = "1.0", where: str = "true", top: int = 100) -> str:
    return f"fused as (select qid, file, score, row_number() over (partition by qid order by score desc, first, file) as rank from (select qid, file, round(sum({weight} / ({k} + rank)), 9) as score, min((ord, rank)) as first from lists where {where} group by 1, 2) qualify rank <= {top})"


@query("rrf", "select qid, file, score, rank from fused", *LISTS, _fused(60))
def rrf(m):
    return fusion.rrf(lists(m))


@query("rrf_weighted", "select qid, file, score, rank from fused", *LISTS, _fused(60, "case list when 'bm' then 1.5 else 1.0 end"))
def rrf_weighted(m):
    return fusion.rrf(lists(m), weights=fusion.WEIGHTS)


@query("rrf_excluded", "select qid, file, score, rank from fused", *LISTS, _fused(40, where="list <> 'gr'"))
def rrf_excluded(m):
    return fusion.rrf(lists(m), k=fusion.RRF_K, exclude=fusion.EXCLUDED)


@query("rrf_provenance", "select qid, file, round(sum(1.0 / (40 + rank)), 9) as score, string_agg(list || ':' || rank, ',' order by ord) as lists from lists where list <> 'gr' group by 1, 2", *LISTS)
def provenance(m):
    out = fusion.rrf(lists(m), k=40, exclude=("gr",), top=None, provenance=True)
    return out.select("qid", "file", "score", F.array_join(F.transform("provenance", lambda x: F.concat(x["list"], F.lit(":"), x["rank"].cast("string"))), ",").alias("lists"))


_DEMOTED = "select qid, file, path, place as rank from (select qid, file, path, row_number() over (partition by qid order by {}, rank) as place from (select * from fused where rank <= 200) join aux using (file)) where place <= 100"
# some paths are made auxiliary, so that the predicates have something to find
_AUX = "aux as (select file, case when p_size <= 5 then 'docs/' || path when p_size <= 10 then 'src/tests/' || path when p_size <= 12 then 'src/Latest_' || path else path end as path from files)"


def _aux_paths(m: Model):
    size, path = F.col("p_size"), F.col("path")
    made = F.when(size <= 5, F.concat(F.lit("docs/"), path)).when(size <= 10, F.concat(F.lit("src/tests/"), path)).when(size <= 12, F.concat(F.lit("src/Latest_"), path)).otherwise(path)
    return m.files.select("file", made.alias("path"))


def _demote(m: Model, predicate):
    fused = fusion.rrf(lists(m), top=200).join(_aux_paths(m), "file")
    return fusion.demote(fused, predicate(F.col("path"))).select("qid", "file", "path", "rank")


@query("demote", _DEMOTED.format("(contains(lower(path), 'test') or starts_with(split_part(path, '/', 1), 'doc'))"), *LISTS, _fused(60, top=200), _AUX)
def demoted(m):
    return _demote(m, fusion.is_aux)


@query("demote_tests", _DEMOTED.format("(contains(path, 'test') or starts_with(path, 'doc'))"), *LISTS, _fused(60, top=200), _AUX)
def demoted_old(m):
    return _demote(m, fusion.is_aux_old)


@query(
    "demote_dirs",
    _DEMOTED.format("(list_has_any(list_slice(string_split(lower(path), '/'), 1, -2), ['tests', 'test', 'docs', 'doc', 'examples', 'benchmarks']) or starts_with(list_extract(string_split(lower(path), '/'), -1), 'test_') or ends_with(lower(path), '_test.py'))"),
    *LISTS,
    _fused(60, top=200),
    _AUX,
)
def demoted_dirs(m):
    return _demote(m, fusion.is_aux_dir)


@query(
    "diversity_cap",
    "select qid, file, row_number() over (partition by qid order by spilled, rank) as rank from (select f.*, row_number() over (partition by qid, dir order by rank) > 2 as spilled from fused f join files using (file))",
    *LISTS,
    _fused(60),
)
def diverse(m):
    fused = fusion.rrf(lists(m)).join(paths(m), "file")
    return fusion.diversity_cap(fused, F.col("dir"), 2).select("qid", "file", "rank")


@query(
    "score_sum",
    "select qid, file, score, row_number() over (partition by qid order by score desc, first, file) as rank from (select qid, file, round(sum(score / most), 8) as score, min((ord, rank)) as first from (select *, case when max(score) over (partition by qid, list) = 0 then 1 else max(score) over (partition by qid, list) end as most from lists) group by 1, 2) qualify rank <= 100",
    *LISTS,
)
def summed(m):
    return fusion.score_sum(lists(m))


@query(
    "capped_union",
    "select qid, file, row_number() over (partition by qid order by first, file) as rank from (select qid, file, min((case list when 'bm' then 0 when 'gr' then 1 else 2 end, rank)) as first from lists where rank <= case list when 'bm' then 80 when 'gr' then 30 else 15 end group by 1, 2) qualify rank <= 100",
    *LISTS,
)
def union(m):
    return fusion.capped_union(lists(m), {"bm": 80, "gr": 30, "rec": 15})


@query(
    "recency_rerank",
    "select qid, file, score, row_number() over (partition by qid order by score desc, rank) as rank from (select b.qid, b.file, b.rank, round((100 - (b.rank - 1)) / 100.0 + 0.3 * coalesce(r.score, 0) / (select max(score) from recall), 8) as score from bm b left join recall r using (file))",
    *BM,
    *REC,
)
def reranked(m):
    prior = history.priors(alive(m)).select("file", F.round("recency", 6).alias("recency"))
    return fusion.recency_rerank(bm(m), prior)


@query("vote", "select qid, file, votes, best, row_number() over (partition by qid order by votes desc, best, file) as rank from (select qid, file, count(*) as votes, min(rank) as best from lists where rank <= 5 group by 1, 2)", *LISTS)
def votes(m):
    return fusion.vote(lists(m))


@query(
    "sc_vote",
    "select qid, file, votes, mean_rank, row_number() over (partition by qid order by votes desc, mean_rank, file) as rank from (select qid, file, sum((rank <= 5)::int)::bigint as votes, round(avg(rank), 6) as mean_rank from lists where rank <= 10 group by 1, 2) where votes > 0",
    *LISTS,
)
def mean_votes(m):
    return fusion.mean_rank_vote(lists(m))


@query("borda", "select qid, file, score, row_number() over (partition by qid order by score desc, file) as rank from (select qid, file, sum(n - rank + 1)::bigint as score from (select *, max(rank) over (partition by qid, list) as n from lists) group by 1, 2)", *LISTS)
def borda(m):
    return fusion.borda(lists(m))


REPLY = """replies as (select conv_id, 'I pick ["' || min(role) || '", "zz", "' || max(role) || '", " tool "] from [all]' as raw, ['user', 'assistant', 'tool', 'system'] as cands from conversations group by conv_id)"""


@query(
    "parse_reply",
    """select conv_id, array_to_string(list_filter(list_distinct_ordered, lambda x: list_contains(cands, x)), ',') as ranked from (select conv_id, cands, case when lo = hi then [lo, 'zz', 'tool'] else [lo, 'zz', hi, 'tool'] end as list_distinct_ordered from (select conv_id, min(role) as lo, max(role) as hi, ['user', 'assistant', 'tool', 'system'] as cands from conversations group by conv_id))""",
)
def reply(m):
    cands = F.array(*map(F.lit, ("user", "assistant", "tool", "system")))
    raw = F.concat(F.lit('I pick ["'), F.min("role"), F.lit('", "zz", "'), F.max("role"), F.lit('", " tool "] from [all]'))
    said = m.table("conversations").groupBy("conv_id").agg(raw.alias("raw"))
    return said.select("conv_id", F.array_join(fusion.parse_reply(F.col("raw"), cands), ",").alias("ranked"))


@query(
    "parse_reply_fallback",
    "select conv_id, case when conv_id % 3 = 0 then 'user,assistant,tool,system' when conv_id % 3 = 1 then 'tool' else 'user,assistant,tool,system' end as ranked, case when conv_id % 3 = 1 then 'tool' else 'user,assistant' end as first from (select distinct conv_id from conversations)",
)
def broken_replies(m):
    """Replies without a list, with a good one, and with one that is no JSON."""
    cands = F.array(*map(F.lit, ("user", "assistant", "tool", "system")))
    key = F.col("conv_id") % 3
    raw = F.when(key == 0, "no list at all").when(key == 1, 'so: ["zz", "tool"]').otherwise('["user", assistant]')
    text = lambda c: F.array_join(c, ",")
    return m.table("conversations").select("conv_id").distinct().select("conv_id", text(fusion.parse_reply(raw, cands)).alias("ranked"), text(fusion.parse_reply(raw, cands, 2)).alias("first"))


@query(
    "backfill",
    "select conv_id, array_to_string(list_concat(got, list_filter(['user', 'assistant', 'tool'], lambda x: not list_contains(got, x))), ',') as ranked from (select conv_id, case when min(role) = max(role) then [min(role)] else [max(role), min(role)] end as got from conversations group by conv_id)",
)
def backfilled(m):
    got = m.table("conversations").groupBy("conv_id").agg(F.array(F.max("role"), F.min("role")).alias("got"))
    return got.select("conv_id", F.array_join(fusion.backfill(F.col("got"), F.array(F.lit("user"), F.lit("assistant"), F.lit("tool"))), ",").alias("ranked"))


@query("prompt", "select conv_id, left(max(text) filter (turn = 0), 1500) || '\n\n' || '1. ' || min(role) || '\n' || '2. ' || max(role) as prompt from conversations group by conv_id having max(text) filter (turn = 0) is not null")
def prompts(m):
    asked = m.table("conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("text"), F.array(F.min("role"), F.max("role")).alias("cands"))
    return asked.filter("text is not null").select("conv_id", fusion.prompt(F.col("text"), F.col("cands")).alias("prompt"))


@query(
    "evidence_text",
    """select qid, file, concat_ws('; ', 'co-changed with ' || c.seed || ' x' || c.raw, 'import link to ' || l.seed, case when round(p / most, 4) > 0 then 'graph score ' || round(round(p / most, 4)::decimal(12, 4), 2)::varchar end) as line
       from hyb left join (select qid, file, max_by(seed, (raw, -place)) as seed, max(raw) as raw from (select met.*, raw from met join pairs on pairs.src = least(met.file, seed) and pairs.dst = greatest(met.file, seed)) group by 1, 2) c using (qid, file)
       left join (select qid, file, min_by(seed, place) as seed from met join static on static.src = least(met.file, seed) and static.dst = greatest(met.file, seed) group by 1, 2) l using (qid, file)
       left join (select qid, node as file, p, max(p) over (partition by qid) as most from p3) g using (qid, file)""",
    *LAYERS,
    *BM,
    SEEDS,
    *_steps(3),
    *HYBRID,
    "met as (select h.qid, h.file, b.file as seed, b.rank as place from hyb h join bm b on b.qid = h.qid and b.rank <= 10 and b.file <> h.file)",
)
def chips(m):
    found, p = bm(m), propagated(m, 3).persist()
    ranked = graph.hybrid_rank(found, p, top=100)
    e = fusion.evidence(ranked, found, pairs(m), m.static_edges, p)
    return e.select("qid", "file", fusion.render(F.col("with_file"), F.col("count"), F.col("link"), F.col("graph")).alias("line"))


# ---------------------------------------------------------------- localize


@query("localize")
def localized(m):
    from graphloom.plans.localize import localize

    return localize(m)


# ---------------------------------------------------------------- evaluation

FOUND = "found as (select l.list, g.qid, l.rank from lists l join gold g using (qid, file))"
NEED = "need as (select qid, count(*) as n_gold from gold group by qid)"
GRID = "grid as (select list, qid, n_gold from (select distinct list from lists), need)"


@query("gold_passages", "select qid, file from gold")
def gold(m):
    return m.gold


@query(
    "eval_recall",
    """select list, qid, round(coalesce(n1, 0) / n_gold, 6) as r1, round(coalesce(n5, 0) / n_gold, 6) as r5, round(coalesce(n10, 0) / n_gold, 6) as r10,
       (coalesce(n1, 0) > 0)::bigint as hit1, (coalesce(n5, 0) > 0)::bigint as hit5, (coalesce(n10, 0) > 0)::bigint as hit10, round(coalesce(s, 0) / n_gold, 6) as ap
       from grid left join (select list, qid, sum((rank <= 1)::int) as n1, sum((rank <= 5)::int) as n5, sum((rank <= 10)::int) as n10, sum(k / rank) as s
         from (select *, row_number() over (partition by list, qid order by rank) as k from found where rank <= 50) group by 1, 2) using (list, qid)""",
    *LISTS,
    FOUND,
    NEED,
    GRID,
)
def evaluated(m):
    return evaluation.evaluate(lists(m).persist(), m.gold, "list")


@query("eval_mrr", "select qid, round(coalesce(n, 0) / n_gold, 6) as r10, round(coalesce(1.0 / first, 0), 6) as mrr from need left join (select qid, sum((rank <= 10)::int) as n, min(rank) filter (rank <= 50) as first from bm join gold using (qid, file) group by qid) using (qid)", *BM, NEED)
def mrr(m):
    return evaluation.reciprocal_rank(bm(m), m.gold)


@query(
    "strict_acc",
    "select list, count(*) as n, round(avg((coalesce(n5, 0) = n_gold)::int), 6) as acc5, round(avg((coalesce(n10, 0) = n_gold)::int), 6) as acc10, round(avg((coalesce(n50, 0) = n_gold)::int), 6) as acc50 from grid left join (select list, qid, sum((rank <= 5)::int) as n5, sum((rank <= 10)::int) as n10, sum((rank <= 50)::int) as n50 from found group by 1, 2) using (list, qid) group by list",
    *LISTS,
    FOUND,
    NEED,
    GRID,
)
def strict(m):
    return evaluation.strict(lists(m).persist(), m.gold, (5, 10, 50), "list")


@query(
    "f1_sweep",
    """select theta, round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(case when tp > 0 then 2 * p * r / (p + r) else 0 end), 6) as f1 from (select theta, coalesce(tp, 0) as tp, case when k > 0 then tp / k else 0 end as p, coalesce(tp, 0) / n_gold as r
       from need cross join thetas left join (select theta, qid, count(*) as k, sum((g.file is not null)::int) as tp from near join thetas on ratio >= theta or rank = 1 left join gold g using (qid, file) group by 1, 2) using (theta, qid)) group by theta""",
    *BM,
    NEED,
    "thetas as (select unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::double as theta)",
    "near as (select qid, file, rank, round(score / max(score) over (partition by qid), 6) as ratio from bm qualify rank <= 5)",
)
def sweep(m):
    return evaluation.threshold_f1(bm(m), m.gold, [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])


@query("wilson", "select k, n, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as low, round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as high from (select *, k::double / n as p from (select sum(quality)::bigint as k, count(*) as n from labels))")
def wilson(m):
    counts = m.table("labels").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return counts.select("k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "mcnemar",
    "select a, b, round(least(1.0, 2 * (select sum(exp(lgamma(a + b + 1) - lgamma(j + 1) - lgamma(a + b - j + 1) - (a + b) * ln(2))) from (select unnest(generate_series(0, least(a, b))) as j))), 6) as p from counts",
    "counts as (select c_mktsegment, sum((o_orderstatus = 'F' and o_totalprice > 450000)::int)::bigint as a, sum((o_orderstatus = 'P' and o_totalprice > 450000)::int)::bigint as b from orders join customer on o_custkey = c_custkey group by c_mktsegment)",
)
def mcnemar(m):
    joined = m.table("orders").filter("o_totalprice > 450000").join(m.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = joined.groupBy("c_mktsegment").agg(F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("a"), F.sum((F.col("o_orderstatus") == "P").cast("int")).alias("b"))
    return counts.select("a", "b", F.round(stats.mcnemar(F.col("a"), F.col("b")), 6).alias("p"))


@query(
    "paired_counts",
    "select sum((x and not y)::int)::bigint as a_only, sum((not x and y)::int)::bigint as b_only, sum((x and y)::int)::bigint as both, sum((not x and not y)::int)::bigint as neither from (select quality = 1 as x, toxic = 1 as y from labels)",
)
def paired(m):
    labels = m.table("labels")
    long = labels.select(F.col("doc_id").alias("qid"), F.lit("quality").alias("system"), F.col("quality").alias("hit")).unionAll(labels.select(F.col("doc_id").alias("qid"), F.lit("toxic").alias("system"), F.col("toxic").alias("hit")))
    return evaluation.paired_counts(long, "quality", "toxic")


@query(
    "quartile_bucket",
    "select doc_id, n_chars, case when n_chars <= t1 then 1 when n_chars <= t2 then 2 when n_chars <= t3 then 3 else 4 end::bigint as bucket from documents, (select s[n // 4 + 1] as t1, s[2 * n // 4 + 1] as t2, s[3 * n // 4 + 1] as t3 from (select list_sort(list(n_chars)) as s, count(*) as n from documents))",
)
def quartiles(m):
    return evaluation.quartile_buckets(m.table("documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "n_chars", "bucket")


@query("p90_index", "select event_type, count(*) as n, round(median(value), 6) as median, round(list_sort(list(value))[floor(0.9 * count(*))::int + 1], 6) as p90 from events group by event_type")
def p90(m):
    return evaluation.runtime_summary(m.table("events"), "event_type", "value")


@query("upper_median", "select dir, round(list_sort(list(p_size))[count(*) // 2 + 1], 6) as mid from files group by dir")
def medians(m):
    return m.files.groupBy("dir").agg(F.round(stats.upper_median(F.collect_list("p_size")).cast("double"), 6).alias("mid")).select("dir", F.col("mid").cast("bigint").alias("mid"))


@query("metric_grouping_sets", "select lang, source, count(*) as n, round(avg(n_chars), 4) as mean from documents group by grouping sets ((lang), (lang, source))")
def grouped(m):
    return evaluation.grouped_means(m.table("documents"), "n_chars", ("lang",), ("lang", "source"))


@query("best_config_per_group", 'select lang, source, mean from (select *, row_number() over (partition by lang order by mean desc, source) as r from (select lang, source, round(avg(n_chars), 6) as mean from documents group by 1, 2)) where r = 1')
def best(m):
    return evaluation.best_per_group(m.table("documents"), "lang", "source", "n_chars")


@query("hash_split", "select url, case when ('0x' || right(sha1(url), 1))::int % 2 = 0 then 'dev' else 'holdout' end as split from pages")
def split(m):
    return m.table("pages").select("url", stats.split_of(F.col("url")).alias("split"))


@query("hash_sample", "select page_id from (select page_id, row_number() over (order by sha1('bake' || page_id), page_id) as r from pages) where r <= 60")
def sample(m):
    keyed = m.table("pages").select("page_id", F.sha1(F.concat(F.lit("bake"), F.col("page_id").cast("string"))).alias("h"))
    return keyed.orderBy("h", "page_id").limit(60).select("page_id")


@query("gold_from_patch", "select file, 'src/' || dir || '/' || file || '.py,' || 'z' || file || '.py' as gold from files where 'src/' < 'z'")
def patched(m):
    patch = F.concat(F.lit("diff --git a/z"), "file", F.lit(".py b/z"), "file", F.lit(".py\n@@\ndiff --git a/old.py b/src/"), "dir", F.lit("/"), "file", F.lit(".py\n"))
    return m.files.select("file", F.array_join(evaluation.gold_from_patch(patch), ",").alias("gold"))


@query(
    "ensemble_search",
    """select combo, method, count(*) as n, round(avg((coalesce(found, 0) = n_gold)::int), 6) as acc from (select combo, method, qid, n_gold from (select distinct combo from combos), (select unnest(['rrf', 'vote']) as method), need)
       left join (select combo, method, qid, count(*) as found from (select combo, 'rrf' as method, qid, file from fus qualify row_number() over (partition by combo, qid order by s desc, file) <= 5
         union all select combo, 'vote', qid, file from fus where votes > 0 qualify row_number() over (partition by combo, qid order by votes desc, best, file) <= 5) join gold using (qid, file) group by 1, 2, 3) using (combo, method, qid) group by 1, 2""",
    *LISTS,
    NEED,
    "combos as (select * from (values ('bm+gr', 'bm'), ('bm+gr', 'gr'), ('bm+rec', 'bm'), ('bm+rec', 'rec'), ('gr+rec', 'gr'), ('gr+rec', 'rec'), ('bm+gr+rec', 'bm'), ('bm+gr+rec', 'gr'), ('bm+gr+rec', 'rec')) t(combo, list))",
    "fus as (select combo, qid, file, round(sum(1.0 / (60 + rank)), 9) as s, sum((rank <= 5)::int) as votes, min(rank) as best from lists join combos using (list) group by 1, 2, 3)",
)
def ensemble(m):
    return fusion.ensembles(m.gold.select("qid").distinct(), lists(m).persist(), m.gold, ["bm", "gr", "rec"])


@query("static_row_weights", "select src, dst, round(w, 8) as w from srows", *LAYERS)
def static_weights(m):
    return static_rows(m).withColumn("w", F.round("w", 8))




# ---------------------------------------------------------------- recipes and the impact experiment


@query("recipes_final")
def recipes_final(m):
    """Strict accuracy of the four final recipes."""
    from graphloom.plans import recipes

    return recipes.accuracy(recipes.Context(m).sweep(recipes.SWEEP_FINAL), m.gold)


@query("recipes_sources")
def recipes_sources(m):
    """Strict accuracy without each source in turn: the first group of the ablation."""
    from graphloom.plans import recipes

    chosen = {n: r for n, r in recipes.ABLATION.items() if n == "full" or n.startswith("no_")}
    return recipes.accuracy(recipes.Context(m).sweep(chosen), m.gold)


def _both(*lists: str) -> str:
    """Ordered union of two lists in the other engine's SQL."""
    return f"list_concat({lists[0]}, list_filter({lists[1]}, lambda x: not list_contains({lists[0]}, x)))"


def _best(c: str, n: int) -> str:
    return f"list_slice(list_sort({c}), 1, {n})"


_CANDS = "cands as (select user_id, list(h order by first) as c from (select user_id, sha1(event_type || floor(value)::int) as h, min(event_id) as first from events group by 1, 2) group by 1)"
#: Steps of each scheme, every one a column that the next ones may use; the last is the answer.
_SCHEMES = {
    "base50": ("list_slice(c, 1, 50)", _best("{0}", 10), _both("{1}", "{0}")),
    "base100": ("list_slice(c, 1, 100)", _best("{0}", 10), _both("{1}", "{0}")),
    "cascade": ("list_slice(c, 1, 100)", *(_best(f"list_slice({{0}}, {i}, {i + 24})", 8) for i in (1, 26, 51, 76)), _both("{1}", "{2}"), _both("{5}", "{3}"), _both("{6}", "{4}"), _best("{7}", 10), _both("{8}", "{7}"), _both("{9}", "{0}")),
    "window": (_best("list_slice(c, 51, 100)", 10), _both("list_slice(c, 21, 50)", "{0}"), _best("{1}", 10), _both("list_slice(c, 1, 20)", "{2}"), _best("{3}", 10), _both("{4}", "list_slice(c, 1, 100)")),
    "refine2": (_best("list_slice(c, 1, 50)", 10), _both("{0}", "list_slice(c, 51, 90)"), _best("{1}", 10), _both("{2}", "{0}"), _both("{3}", "list_slice(c, 1, 100)")),
    "twopass": (_best("list_slice(c, 1, 50)", 10), _best("list_slice(c, 51, 100)", 10), _both("{0}", "{1}"), _best("{2}", 10), _both("{3}", "{0}"), _both("{4}", "list_slice(c, 1, 100)")),
    "anchor": ("list_slice(c, 1, 50)", _best("{0}", 10), "list_slice({1}, 1, 1)", _best("list_filter({0}, lambda x: not list_contains({2}, x))", 6), _both("{2}", "{3}"), _both("{4}", "{1}"), _both("{5}", "c")),
}


def _scheme_sql() -> tuple[str, ...]:
    parts = [_CANDS]
    for name, steps in _SCHEMES.items():
        before = "cands"
        for i, step in enumerate(steps):
            parts.append(f"{name}_{i} as (select *, {step.format(*(f's{k}' for k in range(i)))} as s{i} from {before})")
            before = f"{name}_{i}"
    return tuple(parts)


@query(
    "schemes",
    " union all ".join(f"select user_id, '{name}' as scheme, md5(array_to_string(s{len(steps) - 1}, ',')) as ranked from {name}_{len(steps) - 1}" for name, steps in _SCHEMES.items()),
    *_scheme_sql(),
)
def scheme(m):
    """All seven schemes around a scorer that sorts: each user's distinct events by their hash."""
    from graphloom.plans import schemes

    events = m.table("events").withColumn("h", F.sha1(F.concat("event_type", F.floor("value").cast("int").cast("string"))))
    first = events.groupBy("user_id", "h").agg(F.min("event_id").alias("first"))
    listed = first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "h"))), lambda x: x["h"]).alias("c"))
    score = lambda a, n: F.slice(F.array_sort(a), 1, n)
    out = F.explode(F.map_from_arrays(F.array(*map(F.lit, schemes.SCHEMES)), F.array(*(F.md5(F.array_join(make(score, F.col("c")), ",")) for make in schemes.SCHEMES.values()))))
    return listed.select("user_id", out.alias("scheme", "ranked"))


LEAVE_OUT = (
    "heads as (select sha, any_value(ts) as ts from changes join commits using (sha) group by sha having count(*) between 2 and 10 order by ts desc, sha limit 60)",
    "asked as (select sha, ts, file as seed from (select h.sha, h.ts, c.file, row_number() over (partition by h.sha order by c.file) as r from heads h join changes c using (sha)) where r <= 2)",
    "gold2 as (select a.sha, a.seed, c.file from asked a join changes c on c.sha = a.sha and c.file <> a.seed)",
    "past as (select s.sha, s.file, c.ts from small s join commits c using (sha))",
    "near as (select a.sha, a.seed, q.file, count(*) as n from asked a join past p on p.file = a.seed and p.ts < a.ts join small q on q.sha = p.sha and q.file <> a.seed group by 1, 2, 3)",
    "ranked as (select *, row_number() over (partition by sha, seed order by n desc, file) as rank from near)",
)


@query(
    "impact_eval",
    "select sha, seed, count(*) as n_gold, round(sum((coalesce(rank, 999) <= 10)::int) / count(*), 6) as r10, round(coalesce(1.0 / min(rank) filter (rank <= 50), 0), 6) as mrr from gold2 left join ranked using (sha, seed, file) group by 1, 2",
    *LEAVE_OUT,
)
def impact_eval(m):
    """Leave-one-out over the newest commits: neighbours by count in the history before each commit, batched by (commit, seed)."""
    from pyspark.sql import Window as W

    from graphloom.sources.tables import BULK

    heads = history.head_commits(m.changes, m.commits)
    inside = heads.select("sha", "ts").join(m.changes, "sha")
    asked = inside.withColumn("r", F.row_number().over(W.partitionBy("sha").orderBy("file"))).filter("r <= 2").select("sha", "ts", F.col("file").alias("seed"))
    small = history.bulk_filter(m.changes, BULK)
    dated = small.join(m.commits, "sha").select(F.col("sha").alias("past"), F.col("file").alias("seed"), F.col("ts").alias("then"))
    before = F.broadcast(asked).join(dated, "seed").filter("then < ts")
    near = before.join(small.select(F.col("sha").alias("past"), "file"), "past").filter("file <> seed").groupBy("sha", "seed", "file").agg(F.count(F.lit(1)).alias("n"))
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("sha", "seed").orderBy(F.desc("n"), "file")))
    gold = asked.select("sha", "seed").join(m.changes, "sha").filter("file <> seed")
    met = gold.join(ranked.select("sha", "seed", "file", "rank"), ["sha", "seed", "file"], "left").groupBy("sha", "seed")
    found = met.agg(F.count(F.lit(1)).alias("n_gold"), F.sum(F.when(F.col("rank") <= 10, 1).otherwise(0)).alias("k"), F.min(F.when(F.col("rank") <= 50, F.col("rank"))).alias("first"))
    return found.select("sha", "seed", "n_gold", F.round(F.col("k") / F.col("n_gold"), 6).alias("r10"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


@query(
    "companion_expansion",
    "select qid, file, rank from (select qid, file, row_number() over (partition by qid order by place, w desc, file) as rank from (select qid, file, min(place) as place, max(w) as w from (select qid, file, rank as place, 0.0 as w from bm where rank <= 3 union all select b.qid, e.dst, 10, e.w from bm b join (select src, dst, round(decayed, 6) as w, row_number() over (partition by src order by round(decayed, 6) desc, dst) as r from every_way) e on e.src = b.file and e.r <= 5 where b.rank <= 3) group by 1, 2)) where rank <= 15",
    *BM,
    "every as (select a.file as src, b.file as dst, sum(exp(-a.age / 90.0)) as decayed from history a join history b on a.sha = b.sha and a.file < b.file group by 1, 2)",
    "every_way as (select src, dst, decayed from every union all select dst, src, decayed from every)",
)
def companions(m):
    """The first three files, then each one's five strongest co-change neighbours, in the tree or not, fifteen in all."""
    from pyspark.sql import Window as W

    from graphloom.sources.tables import BASE, BULK

    live = history.bulk_filter(m.changes, BULK).join(history.until(m.commits, BASE), "sha").withColumn("age", history.age_days(F.col("ts"), BASE))
    head = bm(m).filter("rank <= 3").select("qid", "file", "rank")
    near = history.symmetric(history.cochange_pairs(live), "decayed").withColumn("w", F.round("decayed", 6))
    near = near.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy(F.desc("w"), "dst"))).filter("r <= 5")
    more = head.join(near.select(F.col("src").alias("file"), "dst", "w"), "file").select("qid", F.col("dst").alias("file"), F.lit(10).alias("place"), "w")
    every = head.select("qid", "file", F.col("rank").alias("place"), F.lit(0.0).alias("w")).unionAll(more).groupBy("qid", "file").agg(F.min("place").alias("place"), F.max("w").alias("w"))
    ranked = every.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("place", F.desc("w"), "file")))
    return ranked.filter("rank <= 15").select("qid", "file", "rank")
