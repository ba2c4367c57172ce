"""Consensus gene modules from many factorisations.

Bases are long: (study, rank_idx, factor_idx, gene, coef).  Program
selection, overlaps, filters, communities and the dendrogram are windows and
joins; only the greedy growth, over programs (not genes x samples), runs on
the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import _validate as check
from .._shared import written
from ..functions.columns import average_rank
from .communities import map_equation
from .linkage import average_linkage
from .scan import ordered_scan

FACTOR = ["study", "rank_idx", "factor_idx"]


def jaccard(items: DataFrame, key: str = "program", item: str = "gene") -> DataFrame:
    """(left, right, jaccard) of all pairs of sets that share an item, both ways and with themselves: a join on the item and sizes."""
    d = items.select(F.col(key).alias("left"), F.col(item).alias("_i")).distinct()
    n = d.groupBy("left").agg(F.count(F.lit(1)).alias("_n"))
    o = d.select(F.col("left").alias("right"), "_i")
    both = d.join(o, "_i").groupBy("left", "right").agg(F.count(F.lit(1)).alias("_b"))
    both = both.join(n, "left").join(n.select(F.col("left").alias("right"), F.col("_n").alias("_m")), "right")
    return both.select("left", "right", (F.col("_b") / (F.col("_n") + F.col("_m") - F.col("_b"))).alias("jaccard"))


def leading_genes(basis: DataFrame) -> DataFrame:
    """Genes that lead a factor: first in their own row and, in the factor's column of normalised scores, in places 1, 2, .. without a gap.

    Scores are divided by the factor's mean.  (study, rank_idx, factor_idx,
    gene, place).
    """
    norm = F.col("coef") / F.avg("coef").over(Window.partitionBy(*FACTOR))
    d = basis.withColumn("_s", norm)
    d = d.withColumn("_row", average_rank("_s", ["study", "rank_idx", "gene"], descending=True)).withColumn("_col", average_rank("_s", FACTOR, descending=True))
    own = d.where(F.col("_row") <= 1)
    w = Window.partitionBy(*FACTOR).orderBy("_col", "gene")
    return own.withColumn("place", F.row_number().over(w)).where(F.col("_col") == F.col("place")).select(*FACTOR, "gene", "place")


def study_modules(basis: DataFrame, min_size: int = 5) -> DataFrame:
    """(study, rank_idx, program, gene): modules of each study's best rank.

    Factors whose module is smaller than ``min_size`` are left out and the
    rest judged again; the best rank loses fewest factors, larger ranks first
    on ties.
    """
    first = leading_genes(basis).groupBy(*FACTOR).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size)
    kept = basis.join(first.select(*FACTOR), FACTOR, "left_semi")
    modules = leading_genes(kept)
    lost = basis.groupBy("study", "rank_idx").agg(F.count_distinct("factor_idx").alias("_rank")).join(kept.groupBy("study", "rank_idx").agg(F.count_distinct("factor_idx").alias("_kept")), ["study", "rank_idx"])
    best = lost.groupBy("study").agg(F.min_by("rank_idx", F.struct(F.col("_rank") - F.col("_kept"), -F.col("_rank"), "rank_idx")).alias("rank_idx"))
    return modules.join(best, ["study", "rank_idx"]).select("study", "rank_idx", F.concat_ws(".", *FACTOR).alias("program"), "gene")


def recurrent_modules(modules: DataFrame, min_jaccard: float = 0.05, least: int = 3) -> DataFrame:
    """Modules that overlap at least ``least`` modules (themselves included) by more than ``min_jaccard``."""
    sim = jaccard(modules).where(F.col("jaccard") > min_jaccard).groupBy(F.col("left").alias("program")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return modules.join(sim.select("program"), "program", "left_semi")


def co_occurrence(modules: DataFrame, v_min: int = 2, s_min: int = 3) -> DataFrame:
    """(gene1, gene2, weight), gene1 < gene2: how many modules hold both; weights under ``v_min`` and then genes of fewer than ``s_min`` neighbours go."""
    a, b = modules.select("program", F.col("gene").alias("gene1")).distinct(), modules.select("program", F.col("gene").alias("gene2")).distinct()
    e = a.join(b, "program").where("gene1 < gene2").groupBy("gene1", "gene2").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= v_min)
    deg = e.select(F.col("gene1").alias("g")).union(e.select(F.col("gene2").alias("g"))).groupBy("g").count().where(F.col("count") >= s_min).select("g")
    return e.join(deg.withColumnRenamed("g", "gene1"), "gene1", "left_semi").join(deg.withColumnRenamed("g", "gene2"), "gene2", "left_semi").select("gene1", "gene2", "weight")


def label_propagation(edges: list[tuple[str, str, float]], rounds: int = 100) -> dict[str, int]:
    """Deterministic weighted label propagation over a small graph: the default community step."""
    near: dict[str, dict[str, float]] = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    label = {v: i for i, v in enumerate(sorted(near))}
    for _ in range(rounds):
        moved = False
        for v in sorted(near):
            score: dict[int, float] = {}
            for u, w in near[v].items():
                score[label[u]] = score.get(label[u], 0.0) + w
            best = min(score, key=lambda k: (-score[k], k != label[v], k))
            if best != label[v]:
                label[v], moved = best, True
        if not moved:
            break
    return label


def gene_communities(edges: DataFrame) -> DataFrame:
    """(gene, community) of the graph (gene1, gene2, weight) by the map equation; a community is named by the number of its first gene in order."""
    edges = written(edges, "nmf-edges")
    genes = ordered_scan(edges.select(F.explode(F.array("gene1", "gene2")).alias("gene")).distinct(), [F.col("gene")], place="place")
    genes = written(genes.select("gene", (F.col("place") - 1).alias("node")), "nmf-genes")
    of = lambda c, k: genes.select(F.col("gene").alias(c), F.col("node").alias(k))
    label, _ = map_equation(edges.join(of("gene1", "a"), "gene1").join(of("gene2", "b"), "gene2").select("a", "b", F.col("weight").alias("w")))
    return genes.join(label, "node").select("gene", F.col("module").alias("community"))


def program_order(programs: DataFrame) -> DataFrame:
    """(program, weight, place): programs along the dendrogram of average linkage over their Jaccard similarities."""
    sim = jaccard(programs).withColumnRenamed("jaccard", "similarity")
    _, leaves = average_linkage(sim, programs.select(F.col("program").alias("item")))
    return leaves.select(F.col("item").alias("program"), "weight", "place")


@dataclass
class ConsensusModule:
    """modules: {name: genes}; programs: {name: program ids}; raw: the programs it was built from."""

    modules: dict[str, list[str]]
    programs: dict[str, list[str]]
    raw: DataFrame

    def __repr__(self) -> str:
        return f"ConsensusModule({len(self.modules)} modules, {sum(map(len, self.modules.values()))} genes)"

    def to_df(self) -> DataFrame:
        rows = [(m, i + 1, g) for m, genes in self.modules.items() for i, g in enumerate(genes)]
        return self.raw.sparkSession.createDataFrame(rows, "module string, place int, gene string")


def consensus_barkley(basis: DataFrame, min_size: int = 5, min_jaccard: float = 0.05, s_min_jaccard: int = 3, v_min: int = 2, s_min: int = 3, cluster_fn: Callable | None = None) -> ConsensusModule:
    """Communities of the genes' co-occurrence graph by the map equation, over joins.

    ``cluster_fn`` replaces that step: it takes the edges (gene, gene, weight)
    on the driver and returns {gene: label}, like :func:`label_propagation`.
    """
    raw = written(study_modules(basis, min_size), "nmf-modules")  # genes of modules; joined with itself below
    edges = co_occurrence(recurrent_modules(raw, min_jaccard, s_min_jaccard), v_min, s_min)
    if cluster_fn is None:
        labels = dict(gene_communities(edges).collect())  # the result: a label for each gene of a module
    else:
        labels = cluster_fn([(r.gene1, r.gene2, float(r.weight)) for r in edges.collect()])
    groups: dict[int, list[str]] = {}
    for g, k in sorted(labels.items()):
        groups.setdefault(k, []).append(g)
    big = [g for _, g in sorted(groups.items(), key=lambda x: (-len(x[1]), x[1][0])) if len(g) >= min_size]
    return ConsensusModule({f"MP{i + 1}": g for i, g in enumerate(big)}, {}, raw)


def top_programs(basis: DataFrame, module_size: int = 50, coef_threshold: float = 0.0, min_size: int = 3) -> DataFrame:
    """(study, rank_idx, program, gene, coef): each factor's ``module_size`` largest coefficients over the threshold (ties by gene), of factors that have ``min_size``."""
    w = Window.partitionBy(*FACTOR)
    d = basis.where(F.col("coef") > coef_threshold).withColumn("_i", F.row_number().over(w.orderBy(F.desc("coef"), "gene"))).where(F.col("_i") <= module_size)
    d = d.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= min_size)
    return d.select("study", "rank_idx", F.concat_ws(".", *FACTOR).alias("program"), "gene", "coef")


def robust_programs(programs: DataFrame, n_ranks: DataFrame, min_intra_sim: float = 0.7, min_intra_size: int | None = None, min_inter_sim: float = 0.2, min_inter_size: int = 1) -> DataFrame:
    """(study, program, inter): programs found again at other ranks of their study and in other studies.

    ``n_ranks`` is (study, n); without ``min_intra_size`` a program must recur
    at n - 1 others.
    """
    study = programs.select("study", "program").distinct()
    s = jaccard(programs).where("left != right").join(study.withColumnsRenamed({"study": "_ls", "program": "left"}), "left").join(study.withColumnsRenamed({"study": "_rs", "program": "right"}), "right")
    intra = s.where((F.col("_ls") == F.col("_rs")) & (F.col("jaccard") >= min_intra_sim)).groupBy(F.col("left").alias("program")).agg(F.count(F.lit(1)).alias("_n"))
    need = F.lit(min_intra_size) if min_intra_size is not None else F.col("n") - 1
    stable = study.join(intra, "program", "left").join(n_ranks, "study").where(F.coalesce("_n", F.lit(0)) >= need).select("study", "program")
    live = stable.select("program")
    inter = s.where((F.col("_ls") != F.col("_rs")) & (F.col("jaccard") >= min_inter_sim)).join(live.withColumnRenamed("program", "left"), "left", "left_semi").join(live.withColumnRenamed("program", "right"), "right", "left_semi")
    inter = inter.groupBy(F.col("left").alias("program")).agg(F.count_distinct("_rs").alias("inter"))
    return stable.join(inter, "program", "left").withColumn("inter", F.coalesce("inter", F.lit(0))).where(F.col("inter") >= min_inter_size)


def consensus_gavish(basis: DataFrame, min_size: int = 3, coef_threshold: float = 0.0, module_size: int = 50, min_intra_sim: float = 0.7, min_intra_size: int | None = None, min_inter_sim: float = 0.2, min_inter_size: int = 1, redundant_sim: float = 0.2, min_consensus_sim: float = 0.2, founder_intersection: float = 0.2, min_overlap_index: float = 0.2, overlap_fn: Callable[[set, set], float] | None = None) -> ConsensusModule:
    """Meta-programs by greedy growth from the program that overlaps most others.

    After the distributed filters a few programs for each study are left;
    redundancy and growth run over them on the driver.  ``overlap_fn`` (two
    sets to a number; default Jaccard) is used there; the filters use Jaccard.
    """
    check.number(founder_intersection, "founder_intersection", 0)
    overlap = overlap_fn or (lambda a, b: len(a & b) / len(a | b) if a | b else 0.0)
    programs = top_programs(basis, module_size, coef_threshold, min_size)
    ranks = basis.groupBy("study").agg(F.count_distinct("rank_idx").alias("n"))
    good = robust_programs(programs, ranks, min_intra_sim, min_intra_size, min_inter_sim, min_inter_size)
    rows = programs.join(good, ["study", "program"]).collect()
    genes: dict[str, list] = {}
    coef: dict[str, dict[str, float]] = {}
    info = {}
    for r in sorted(rows, key=lambda r: (r.program, -r.coef, r.gene)):
        genes.setdefault(r.program, []).append(r.gene)
        coef.setdefault(r.program, {})[r.gene] = r.coef
        info[r.program] = (r.study, r.inter)
    kept: list[str] = []
    for p in sorted(genes, key=lambda p: (str(info[p][0]), -info[p][1], p)):
        same = [q for q in kept if info[q][0] == info[p][0]]
        if not same or max(overlap(set(genes[p]), set(genes[q])) for q in same) < redundant_sim:
            kept.append(p)
    left = {p: genes[p] for p in kept}
    alive = set(kept)
    modules, members = {}, {}
    while alive:
        count = {p: sum(overlap(set(genes[p]), set(genes[q])) >= min_consensus_sim for q in alive) - 1 for p in alive}
        need = (len(alive) - 1) * founder_intersection if 0 < founder_intersection < 1 else founder_intersection
        founder = min(alive, key=lambda p: (-count[p], p))
        if count[founder] < need:
            break
        chosen, current, pool = [founder], list(genes[founder]), list(genes[founder])
        left.pop(founder, None)
        while left:
            score = {p: overlap(set(current), set(g)) for p, g in left.items()}
            best = min(score, key=lambda p: (-score[p], p))
            if score[best] < min_overlap_index:
                break
            chosen.append(best)
            pool += left.pop(best)
            n: dict[str, int] = {}
            for g in pool:
                n[g] = n.get(g, 0) + 1
            order = sorted(n, key=lambda g: (-n[g], g))
            if len(order) > module_size:
                edge = n[order[module_size - 1]]
                border = [g for g in order if n[g] == edge]
                weight = {g: max((coef[p].get(g, 0.0) for p in chosen), default=0.0) for g in border}
                order = [g for g in order if n[g] > edge] + sorted(border, key=lambda g: (-weight[g], g))
            current = order[:module_size]
        name = f"MP{len(modules) + 1}"
        modules[name], members[name] = current, chosen
        alive -= set(chosen)
    return ConsensusModule(modules, members, programs)


def nmf_consensus(basis: DataFrame, method: str = "barkley", **options) -> ConsensusModule:
    check.columns(basis, [*FACTOR, "gene", "coef"], "basis")
    return {"barkley": consensus_barkley, "gavish": consensus_gavish}[check.choice(method, ("barkley", "gavish"), "method")](basis, **options)
