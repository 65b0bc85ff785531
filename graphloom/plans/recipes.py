"""Named ranking recipes: what each takes, as data, and one plan that carries any of them out.

A ``Context`` keeps what recipes share (priors, seed lists, layers, propagated mass);
a recipe is a row of settings. Every recipe ranks all issues at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators import evaluation, fusion, graph, history, retrieval
from graphloom.sources.tables import BASE, BULK, Model

FIVE = ("bm", "gr", "ppr_bm", "ppr_gr", "rec")
SEVEN = fusion.ORDER
SIX = tuple(x for x in SEVEN if x != "gr")


@dataclass(frozen=True)
class Recipe:
    lists: tuple[str, ...] = SIX
    fuse: str = "rrf"  # rrf, sum or union
    k: int = 60
    weights: dict[str, float] | None = None
    caps: dict[str, int] | None = None  # of a union, in order
    layer: str = "mixed"
    alpha: float = graph.ALPHA
    damping: float = graph.DAMPING
    steps: int = graph.STEPS
    bm_steps: int | None = None  # of the propagation from bm alone, with damping 0.6
    depth: int = 100  # of each list
    depths: dict[str, int] = field(default_factory=dict)
    demote: str | None = None  # name, old or dirs
    spread: int = 0  # most files of a directory before the overflow
    recency: float = 0.0  # share of recency in a second ranking
    explicit_first: bool = False
    top: int = 100


UNION = Recipe(fuse="union", caps={"ppr_bm": 80, "ppr_gr": 30, "bm": 15})
FUSED = Recipe(lists=SEVEN)
WINNER = replace(FUSED, demote="name")
FINAL = Recipe(k=fusion.RRF_K, demote="name")
ABLATED = replace(FINAL, top=50)

SWEEP_1 = {
    "baseline": UNION,
    "paths": replace(UNION, explicit_first=True),
    "rm3": replace(UNION, caps={"ppr_rm3": 80, "ppr_gr": 30, "rm3": 15}),
    "pathbm": replace(UNION, caps={"ppr_bm": 70, "ppr_gr": 25, "path": 15, "bm": 10}),
    "recency": replace(UNION, recency=0.3),
    "conf": replace(UNION, layer="confidence"),
    "allfiles": replace(UNION, layer="all"),
    "dirsmooth": replace(UNION, layer="smoothed"),
    "rrf": Recipe(lists=FIVE),
    "demote_tests": replace(UNION, demote="old"),
    "threestep": replace(UNION, bm_steps=3),
}
SWEEP_2 = {
    "baseline": UNION,
    "demote_tests": replace(UNION, demote="old"),
    "rrf_dem": Recipe(lists=FIVE, demote="name"),
    "rrf7": FUSED,
    "rrf7_dem": WINNER,
    "rrf7_dem_k30": replace(WINNER, k=30),
    "rrf7w_dem": replace(WINNER, weights=fusion.WEIGHTS),
    "rrf7_dem_rec": replace(WINNER, recency=0.25),
    "paths_first": replace(WINNER, explicit_first=True),
}
SWEEP_3 = {
    "winner": WINNER,
    "win_dirdem": replace(FUSED, demote="dirs"),
    "win_prtx": replace(WINNER, layer="sessions"),
    "win_d150": replace(WINNER, depth=150),
    "win_k20": replace(WINNER, k=20),
    "win_k90": replace(WINNER, k=90),
    **{f"drop_{name}": replace(WINNER, lists=tuple(x for x in SEVEN if x != name)) for name in SEVEN},
}
_TWO = tuple(x for x in SIX if x != "ppr_gr")
SWEEP_4 = {
    "winner3": WINNER,
    "no_gr": replace(FINAL, k=60),
    "no_gr2": replace(FINAL, k=60, lists=_TWO),
    "no_gr_k20": replace(FINAL, k=20),
    "no_gr2_k20": replace(FINAL, k=20, lists=_TWO),
    "no_gr_k40": FINAL,
    "rec_deep": replace(FINAL, k=60, depths={"rec": 150}),
    "path_deep": replace(FINAL, k=60, depths={"path": 100}),
    "rec_w2": replace(FINAL, k=60, weights={"rec": 2.0}),
    "divers12": replace(FINAL, k=60, spread=12),
}
SWEEP_FINAL = {"baseline": UNION, "winner3": WINNER, "final_k40": FINAL, "final_k20": replace(FINAL, k=20)}
_WITHOUT = {"no_bm25": "bm", "no_ppr_bm": "ppr_bm", "no_ppr_gr": "ppr_gr", "no_recency": "rec", "no_path": "path", "no_explicit": "expl"}
ABLATION = {
    "full": ABLATED,
    **{name: replace(ABLATED, lists=tuple(x for x in SIX if x != gone)) for name, gone in _WITHOUT.items()},
    "no_demote": replace(ABLATED, demote=None),
    "no_graph": replace(ABLATED, lists=("bm", "rec", "path", "expl")),
    "static_only": replace(ABLATED, alpha=1.0),
    "temporal_only": replace(ABLATED, alpha=0.0),
    "alpha50": replace(ABLATED, alpha=0.5),
    "alpha75": replace(ABLATED, alpha=0.75),
    "decay_none": replace(ABLATED, layer="decay_0"),
    "decay_365": replace(ABLATED, layer="decay_365"),
    "decay_30": replace(ABLATED, layer="decay_30"),
    **{f"prop_{n}step": replace(ABLATED, steps=n) for n in (1, 2, 3)},
    "damp_03": replace(ABLATED, damping=0.3),
    "damp_07": replace(ABLATED, damping=0.7),
    "fuse_scoresum": replace(ABLATED, fuse="sum", depths={"ppr_bm": 10**9, "ppr_gr": 10**9, "rec": 10**9}),
    "fuse_union": replace(ABLATED, fuse="union", caps=UNION.caps),
    "rrf_k20": replace(ABLATED, k=20),
    "rrf_k80": replace(ABLATED, k=80),
}
SWEEPS = {"sweep1": SWEEP_1, "sweep2": SWEEP_2, "sweep3": SWEEP_3, "sweep4": SWEEP_4, "final": SWEEP_FINAL, "ablation": ABLATION}
#: Seed list, static share and decay in days of every configuration of the grid (0: none), besides the plain seeds.
GRID = [(seed, alpha, days) for seed in ("bm", "gr") for alpha, days in [*((a, d) for a in (0.0, 0.25, 0.5, 0.75) for d in (0, 90, 365)), (1.0, 90)]]

AUX: dict[str, Callable[[Column], Column]] = {"name": fusion.is_aux, "old": fusion.is_aux_old, "dirs": fusion.is_aux_dir}


class Context:
    """What the recipes of one model share; each piece is made on first use and kept."""

    def __init__(self, model: Model):
        self.m = model
        self._rows: dict[tuple, DataFrame] = {}
        self._mass: dict[tuple, DataFrame] = {}
        self._first: dict[tuple, DataFrame] = {}

    @cached_property
    def alive(self) -> DataFrame:
        return history.alive_changes(self.m.changes, self.m.commits, self.m.tree, BASE, BULK).persist()

    @cached_property
    def terms(self) -> DataFrame:
        return retrieval.query_terms(self.m.issues).persist()

    @cached_property
    def priors(self) -> DataFrame:
        return history.priors(self.alive).withColumn("recency", F.round("recency", 6)).persist()

    def seed(self, name: str) -> DataFrame:
        return getattr(self, f"seed_{name}")

    @cached_property
    def seed_bm(self) -> DataFrame:
        return retrieval.bm25_texts(self.terms, self.m.texts, top=200, cap=None).checkpoint()

    @cached_property
    def seed_gr(self) -> DataFrame:
        from graphloom.plans.search_queries import named_texts

        return retrieval.identifier_search(self.m.issues, named_texts(self.m), top=200).checkpoint()

    @cached_property
    def seed_rm3(self) -> DataFrame:
        more = retrieval.feedback_terms(self.seed_bm, retrieval.counts_of_first(self.seed_bm, self.m.texts, cap=None)).select("qid", "term")
        return retrieval.bm25_texts(self.terms.unionAll(more).distinct(), self.m.texts, top=200, cap=None).checkpoint()

    @cached_property
    def seed_path(self) -> DataFrame:
        return retrieval.path_tokens(self.terms, self.m.tree, top=100).checkpoint()

    @cached_property
    def explicit(self) -> DataFrame:
        return retrieval.quoted_paths(self.m.issues, self.m.tree).checkpoint()

    @cached_property
    def all_recent(self) -> DataFrame:
        """file, score, rank: one list for all queries."""
        one = self.priors.select(F.lit(0).alias("qid"), "file", F.col("recency").alias("score"), (-F.unix_timestamp(F.col("last").cast("timestamp"))).alias("older"))
        return graph.ranked(one, None, "older").drop("qid", "older")

    @cached_property
    def recent(self) -> DataFrame:
        return self.m.issues.select("qid").join(F.broadcast(self.all_recent.filter(F.col("rank") <= 2 * fusion.DEPTH)))

    def recent_with(self, others: DataFrame) -> DataFrame:
        """The whole recency list as far as it can matter to a sum: its first files, and the place of every file that
        another list of the query has. A file in no other list and after the first is behind all of those."""
        own = others.select("qid", "file").distinct().join(self.all_recent, "file").select("qid", "file", "score", "rank")
        return self.recent.select("qid", "file", "score", "rank").unionAll(own).distinct()

    @cached_property
    def static_rows(self) -> DataFrame:
        return graph.row_normalized(self.m.static_edges.withColumn("w", F.lit(1.0)))

    def temporal_rows(self, layer: str) -> DataFrame:
        if layer == "confidence":
            return graph.row_normalized(graph.confidence(history.cochange_pairs(self.alive), self.priors))
        if layer == "sessions":
            author = self.m.table("orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("who"))
            return graph.row_normalized(history.session_pairs(self.alive, author, 3600, BASE), "decayed")
        days = int(layer.removeprefix("decay_")) if layer.startswith("decay_") else 90
        return graph.row_normalized(history.cochange_pairs(self.alive, 1 / days if days else 0), "decayed")

    def rows(self, layer: str, alpha: float) -> DataFrame:
        if (layer, alpha) not in self._rows:
            temporal = self.temporal_rows(layer)
            made = temporal if layer == "all" else graph.mix_rows(self.static_rows, temporal, alpha)
            if layer == "smoothed":
                made = graph.blend(made, graph.row_normalized(graph.dir_chain(self.m.tree)))
            self._rows[layer, alpha] = made.persist()
        return self._rows[layer, alpha]

    def mass(self, seed: str, layer: str, alpha: float, damping: float, steps: int) -> DataFrame:
        key = (seed, layer, alpha, damping, steps)
        if key not in self._mass:
            self._mass[key] = graph.ppr(self.rows(layer, alpha), graph.seed_vector(self.seed(seed)), damping, steps).checkpoint()
        return self._mass[key]

    def ranking(self, name: str, r: Recipe, depth: int) -> DataFrame:
        if name.startswith("ppr_"):
            seed = name.removeprefix("ppr_")
            own = seed == "bm" and r.bm_steps is not None
            key = (seed, r.layer, r.alpha, 0.6 if own else r.damping, r.bm_steps if own else r.steps)
            if depth > 2 * fusion.DEPTH:
                return graph.hybrid_rank(self.seed(seed), self.mass(*key), top=None)
            if key not in self._first:
                self._first[key] = graph.hybrid_rank(self.seed(seed), self.mass(*key), top=2 * fusion.DEPTH).checkpoint()
            return self._first[key]
        return {"rec": lambda: self.recent, "path": lambda: self.seed_path, "expl": lambda: self.explicit}.get(name, lambda: self.seed(name))()

    def rank(self, r: Recipe) -> DataFrame:
        """qid, file, rank of every issue under a recipe."""
        names = tuple(r.caps) if r.fuse == "union" else r.lists
        depths = {"path": 60, "expl": 10, **{n: r.depth for n in names if n not in ("path", "expl")}, **r.depths}
        made = {n: self.ranking(n, r, depths[n]) for n in names}
        if r.fuse == "sum" and "rec" in made:
            others = fusion.list_table({n: df for n, df in made.items() if n != "rec"}, depths)
            made["rec"] = self.recent_with(others)
        lists = fusion.list_table(made, depths)
        over = 2 * fusion.DEPTH
        if r.fuse == "union":
            out = fusion.capped_union(lists, r.caps, top=over)
        elif r.fuse == "sum":
            out = fusion.score_sum(lists, top=over)
        else:
            out = fusion.rrf(lists, r.k, r.weights, top=over)
        placed = out.select("qid", "file", "rank").join(self.m.files.select("file", "path", "dir"), "file", "left")
        if r.spread:
            placed = fusion.diversity_cap(placed, F.col("dir"), r.spread)
        if r.demote:
            placed = fusion.demote(placed, F.coalesce(AUX[r.demote](F.col("path")), F.lit(False)), over, r.top)
        out = placed.filter(F.col("rank") <= r.top).select("qid", "file", "rank")
        if r.recency:
            out = fusion.recency_rerank(out, self.priors, r.recency).select("qid", "file", "rank")
        if r.explicit_first:
            both = fusion.list_table({"expl": self.explicit, "base": out}, {"expl": 10, "base": r.top})
            out = fusion.capped_union(both, {"expl": 10, "base": r.top}, r.top)
        return out

    def sweep(self, recipes: dict[str, Recipe]) -> DataFrame:
        """recipe, qid, file, rank of several recipes."""
        out = None
        for name, r in recipes.items():
            part = self.rank(r).select(F.lit(name).alias("recipe"), "qid", "file", "rank")
            out = part if out is None else out.unionAll(part)
        return out

    def grid(self) -> DataFrame:
        """recipe, qid, file, rank of the grid of seeds, layer shares and decays, and of the seeds alone."""
        out = None
        for seed, alpha, days in GRID:
            p = self.mass(seed, f"decay_{days}", alpha, graph.DAMPING, graph.STEPS)
            part = graph.hybrid_rank(self.seed(seed).filter("rank <= 50"), p).select(F.lit(f"{seed}_a{alpha}_d{days}").alias("recipe"), "qid", "file", "rank")
            out = part if out is None else out.unionAll(part)
        for seed in ("bm", "gr"):
            out = out.unionAll(self.seed(seed).filter("rank <= 50").select(F.lit(seed).alias("recipe"), "qid", "file", "rank"))
        return out


def accuracy(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """recipe, n, acc5, acc10, acc50 of each recipe."""
    return evaluation.strict(rankings.persist(), gold, (5, 10, 50), "recipe")
