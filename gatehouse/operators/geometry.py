"""Geometry between two sets of atoms: distance joins by grid cells, and the features that the interface rules read.

Atoms are rows ``complex, atom, element, x, y, z``; sides are two such frames.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Van der Waals radii (Bondi), with the default for other elements.
BONDI = {
    "H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "F": 1.47, "P": 1.80, "S": 1.80, "Cl": 1.75, "Br": 1.85, "I": 1.98, "B": 1.92, "Si": 2.10,
    "Se": 1.90, "Na": 2.27, "Mg": 1.73, "K": 2.75, "Ca": 2.31, "Zn": 1.39, "Fe": 2.05, "Mn": 2.05, "Cu": 1.40, "Ni": 1.63, "Co": 2.0, "As": 1.85,
}
DEFAULT_RADIUS = 1.70
# Radii of the all-atom contact convention, over the table above.
CONTACT = {"C": 1.75, "N": 1.55, "O": 1.40, "S": 1.80, "P": 1.80, "H": 1.17}
# Clash limits in Å and as shares, and the reach of a contact.
CLASH_OVERLAP, DISULFIDE, CLASH_REL, REACH = 0.40, 2.50, 0.75, 5.0


def radius(element: Column, table: dict[str, float]) -> Column:
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.coalesce(F.try_element_at(known, F.initcap(element)), F.lit(DEFAULT_RADIUS))


def distance(a: str = "a", b: str = "b") -> Column:
    return F.sqrt(sum((F.pow(F.col(f"{a}.{k}") - F.col(f"{b}.{k}"), 2) for k in "xyz"), F.lit(0.0)))


def within(left: DataFrame, right: DataFrame, reach: float, group: str = "complex") -> DataFrame:
    """Pairs ``a, b, dist`` (rows as structs) of one group closer than ``reach``: an equi-join on grid cells.

    Each right row goes to its own cell, each left row to the 27 cells around it, so a pair meets once.
    """
    cell = lambda k: F.floor(F.col(k) / reach)
    b = right.select(F.col(group).alias("g"), F.struct("*").alias("b"), *[cell(k).alias(f"c{k}") for k in "xyz"])
    around = left.select(F.col(group).alias("g"), F.struct("*").alias("a"), *[cell(k).alias(f"c{k}") for k in "xyz"])
    for k in "xyz":
        around = around.withColumn(f"c{k}", F.explode(F.array(*[F.col(f"c{k}") + d for d in (-1, 0, 1)])))
    return around.join(b, ["g", "cx", "cy", "cz"]).select("g", "a", "b", distance().alias("dist")).where(F.col("dist") < reach)


def closest(left: DataFrame, right: DataFrame, near: DataFrame, group: str = "complex") -> DataFrame:
    """``g, min_dist`` for every group with both sides: from the near pairs, else from all pairs of that group alone."""
    hit = near.groupBy("g").agg(F.min("dist").alias("min_dist"))
    both = left.select(F.col(group).alias("g")).distinct().join(right.select(F.col(group).alias("g")).distinct(), "g")
    far = both.join(hit, "g", "left_anti")
    a = left.select(F.col(group).alias("g"), F.struct("*").alias("a")).join(far, "g", "left_semi")
    b = right.select(F.col(group).alias("g"), F.struct("*").alias("b"))
    rest = a.join(b, "g").groupBy("g").agg(F.min(distance()).alias("min_dist"))
    return hit.unionByName(rest)


def ligand_features(protein: DataFrame, ligand: DataFrame, group: str = "complex") -> DataFrame:
    """``g, framed, min_dist, min_rel, n_clash``: the smallest distance and the smallest share of the radii's sum."""
    groups = protein.select(F.col(group).alias("g")).union(ligand.select(F.col(group).alias("g"))).distinct()
    near = within(ligand, protein, REACH, group)
    rel = F.col("dist") / (radius(F.col("a.element"), BONDI) + radius(F.col("b.element"), BONDI))
    pairs = near.groupBy("g").agg(F.min(rel).alias("min_rel"), F.count_if(rel < CLASH_REL).alias("n_clash"))
    out = groups.join(closest(ligand, protein, near, group), "g", "left").join(pairs, "g", "left")
    return out.select("g", F.col("min_dist").isNotNull().alias("framed"), "min_dist", "min_rel", F.coalesce("n_clash", F.lit(0)).alias("n_clash"))


def volume_overlap(protein: DataFrame, ligand: DataFrame, step: float = 0.5, group: str = "complex") -> DataFrame:
    """``g, overlap_frac``: the share of the ligand's grid points that lie inside the protein.

    The grid of ``step`` starts at the ligand's lower corner.  Every ligand atom lists the points of its own ball; points
    meet the protein's atoms over grid cells as wide as the largest ball, so no complex is gathered.
    """
    wide = max(BONDI.values())
    atoms = ligand.select(F.col(group).alias("g"), *[F.col(k).cast("double").alias(k) for k in "xyz"], radius(F.col("element"), BONDI).alias("r"))
    corner = atoms.groupBy("g").agg(*[F.min(F.col(k) - F.col("r")).alias(f"low_{k}") for k in "xyz"])
    points = atoms.join(corner, "g")
    for k in "xyz":
        first, last = (F.floor((F.col(k) + sign * F.col("r") - F.col(f"low_{k}")) / step) for sign in (-1, 1))
        points = points.withColumn(f"i{k}", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    away = lambda x: sum((F.pow(F.col(f"low_{k}") + F.col(f"i{k}") * step - x(k), 2) for k in "xyz"), F.lit(0.0))
    points = points.where(away(F.col) <= F.col("r") * F.col("r")).select("g", "ix", "iy", "iz").distinct().join(corner, "g")
    points = points.select("*", *[F.floor((F.col(f"low_{k}") + F.col(f"i{k}") * step) / wide).alias(f"c{k}") for k in "xyz"])
    balls = protein.select(F.col(group).alias("g"), *[F.col(k).cast("double").alias(f"p{k}") for k in "xyz"], radius(F.col("element"), BONDI).alias("pr"))
    for k in "xyz":
        balls = balls.withColumn(f"c{k}", F.explode(F.array(*[F.floor(F.col(f"p{k}") / wide) + d for d in (-1, 0, 1)])))
    near = points.join(balls, ["g", "cx", "cy", "cz"]).where(away(lambda k: F.col(f"p{k}")) <= F.col("pr") * F.col("pr")).select("g", "ix", "iy", "iz").distinct()
    inside = near.groupBy("g").agg(F.count(F.lit(1)).alias("inside"))
    return points.groupBy("g").agg(F.count(F.lit(1)).alias("all")).join(inside, "g", "left").select("g", (F.coalesce("inside", F.lit(0)) / F.col("all")).alias("overlap_frac"))


def interface_features(side_a: DataFrame, side_b: DataFrame, group: str = "complex") -> DataFrame:
    """``g, framed, min_dist, n_clash, max_overlap, buried_frac`` between two groups of chains.

    A disulfide (S to S within 2.5 Å) is no clash; burial is the share of the smaller side's atom centres inside a sphere of
    the other side.
    """
    n_a = side_a.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n_a"))
    n_b = side_b.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n_b"))
    near = within(side_a, side_b, REACH, group)
    ra, rb = (radius(F.col(f"{s}.element"), BONDI | CONTACT) for s in "ab")
    bond = (F.col("a.element") == "S") & (F.col("b.element") == "S") & (F.col("dist") < DISULFIDE)
    overlap = ra + rb - F.col("dist")
    pairs = near.groupBy("g").agg(
        F.count_if(~bond & (overlap > CLASH_OVERLAP)).alias("n_clash"), F.greatest(F.max(F.when(~bond, overlap)), F.lit(0.0)).alias("max_overlap")
    )
    inside = near.groupBy("g").agg(
        F.countDistinct(F.when(F.col("dist") < rb, F.col("a.atom"))).alias("in_a"), F.countDistinct(F.when(F.col("dist") < ra, F.col("b.atom"))).alias("in_b")
    )
    out = n_a.join(n_b, "g", "full").join(closest(side_a, side_b, near, group), "g", "left").join(pairs, "g", "left").join(inside, "g", "left")
    share = F.when(F.col("n_a") <= F.col("n_b"), F.col("in_a") / F.col("n_a")).otherwise(F.col("in_b") / F.col("n_b"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    framed = F.col("n_a").isNotNull() & F.col("n_b").isNotNull()
    return out.select("g", framed.alias("framed"), "min_dist", zero(F.col("n_clash")).alias("n_clash"), F.coalesce("max_overlap", F.lit(0.0)).alias("max_overlap"), F.coalesce(share, F.lit(0.0)).alias("buried_frac"))


def worst_clashes(side_a: DataFrame, side_b: DataFrame, top: int = 8, group: str = "complex") -> DataFrame:
    """The deepest clashes of each group: ``g, rank, a, b, overlap``, ties by atom."""
    from pyspark.sql import Window as W

    overlap = radius(F.col("a.element"), BONDI | CONTACT) + radius(F.col("b.element"), BONDI | CONTACT) - F.col("dist")
    pairs = within(side_a, side_b, REACH, group).withColumn("overlap", overlap).where(F.col("overlap") > CLASH_OVERLAP)
    rank = F.row_number().over(W.partitionBy("g").orderBy(F.desc("overlap"), F.col("a.atom"), F.col("b.atom")))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= top).select("g", "rank", "a", "b", F.bround("overlap", 2).alias("overlap"))


def moved(atoms: DataFrame, dx: float = 0.0, dy: float = 0.0, dz: float = 0.0) -> DataFrame:
    """A decoy: the same atoms, shifted."""
    return atoms.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "z": F.col("z") + dz})


def all_chain_pairs(atoms: DataFrame, group: str = "complex") -> DataFrame:
    """``g, pairs, n_clash, max_overlap, min_dist`` over all pairs of chains of a complex that come within reach."""
    near = within(atoms, atoms, REACH, group).where("a.chain < b.chain")
    ra, rb = (radius(F.col(f"{s}.element"), BONDI | CONTACT) for s in "ab")
    bond = (F.col("a.element") == "S") & (F.col("b.element") == "S") & (F.col("dist") < DISULFIDE)
    overlap = F.when(~bond, ra + rb - F.col("dist"))
    return near.groupBy("g").agg(
        F.countDistinct("a.chain", "b.chain").alias("pairs"), F.count_if(overlap > CLASH_OVERLAP).alias("n_clash"),
        F.greatest(F.max(overlap), F.lit(0.0)).alias("max_overlap"), F.min("dist").alias("min_dist"),
    )


def primary_pair(atoms: DataFrame, largest: int = 4, reach: float = 6.0, group: str = "complex") -> DataFrame:
    """``g, chain_a, chain_b, contacts``: of the largest chains the pair with most atoms of the first near the second.

    Chains stand in order of size, then name; of equal pairs the first one wins.
    """
    from pyspark.sql import Window as W

    sizes = atoms.groupBy(F.col(group).alias("g"), "chain").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.withColumn("place", F.row_number().over(W.partitionBy("g").orderBy(F.desc("n"), "chain"))).where(F.col("place") <= largest)
    some = atoms.join(top.select(F.col("g").alias(group), "chain", "place"), [group, "chain"])
    near = within(some, some, reach, group).where("a.place < b.place")
    counts = near.groupBy("g", F.col("a.chain").alias("chain_a"), F.col("b.chain").alias("chain_b"), F.col("a.place").alias("pa"), F.col("b.place").alias("pb"))
    counts = counts.agg(F.countDistinct("a.atom").alias("contacts"))
    rank = F.row_number().over(W.partitionBy("g").orderBy(F.desc("contacts"), "pa", "pb"))
    return counts.withColumn("_r", rank).where("_r = 1").select("g", "chain_a", "chain_b", "contacts")


def centroid(atoms: DataFrame, group: str = "complex") -> DataFrame:
    return atoms.groupBy(F.col(group).alias("g")).agg(*[F.avg(k).alias(f"m{k}") for k in "xyz"])


def turned(atoms: DataFrame, axis: tuple[float, float, float], degrees: float, group: str = "complex") -> DataFrame:
    """A decoy: every complex's atoms turned about its centroid (Rodrigues' formula)."""
    import math

    size = math.sqrt(sum(v * v for v in axis)) or 1.0
    u, angle = [v / size for v in axis], math.radians(degrees)
    x = atoms.join(centroid(atoms, group), F.col(group) == F.col("g"))
    p = [F.col(k) - F.col(f"m{k}") for k in "xyz"]
    cross = [u[1] * p[2] - u[2] * p[1], u[2] * p[0] - u[0] * p[2], u[0] * p[1] - u[1] * p[0]]
    along = sum((a * b for a, b in zip(u[1:], p[1:], strict=True)), u[0] * p[0])
    new = [p[i] * math.cos(angle) + cross[i] * math.sin(angle) + u[i] * along * (1 - math.cos(angle)) + F.col(f"m{k}") for i, k in enumerate("xyz")]
    return x.withColumns(dict(zip("xyz", new, strict=True))).select(*atoms.columns)


def carried(atoms: DataFrame, towards: DataFrame, share: float, group: str = "complex") -> DataFrame:
    """A decoy: atoms moved along the line to the other side's centroid; 1 lays centroid on centroid, below 0 leads away."""
    own, other = centroid(atoms, group), centroid(towards, group).toDF("o", "ox", "oy", "oz")
    x = atoms.join(own, F.col(group) == F.col("g")).join(other, F.col(group) == F.col("o"))
    return x.withColumns({k: F.col(k) + share * (F.col(f"o{k}") - F.col(f"m{k}")) for k in "xyz"}).select(*atoms.columns)


def clash_ends(ends: DataFrame) -> DataFrame:
    """``cid, a, b`` from rows ``cid, end``: clashes with exactly two ends, the smaller one first."""
    both = ends.groupBy("cid").agg(F.array_sort(F.collect_list("end")).alias("e"), F.count(F.lit(1)).alias("n")).where("n = 2")
    return both.select("cid", F.get("e", F.lit(0)).alias("a"), F.get("e", F.lit(1)).alias("b"))
