"""Merkle dataset manifest (operator 13) by parent-preimage paths.

A document is a leaf; per source the leaves ascend by doc_id, every three consecutive nodes become
their parent, and the sources' roots become the dataset's root in the same way. A parent is stored as
its preimage: its children's hashes end to end. A leaf joins its ancestors' preimages and cuts its own
64 characters out of each for the siblings; a proof is folded by splicing the node's hash in there.

Nodes are numbered by a sort over ranges, never by a window over a source. Six levels of up to 729
neighbouring nodes are made at once from one row (a pack), so a source of any size is spread over
packs, and a tree of n leaves takes log(n) / log(729) shuffles of its nodes, each 729 times smaller.

Defined results: any null field is `-`; a null source is a source of its own and comes first; null
doc_ids come first in their source; rows of one doc_id follow their leaves' hashes, and equal rows are
leaves of their own, each with its own proof; an empty table has no rows and a null root. Columns
beside the five that are hashed aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ready, stash
from .rows import placed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a parent, levels of a pack, and nodes of a pack.
WIDTH, LEVELS = 3, 6
SPAN = WIDTH**LEVELS
#: Characters of a hash.
HEX = 64
PATH = "array<struct<slot:int,preimage:string>>"


def div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: dict[str, Column] | None = None) -> Column:
    """The hash of a row; fields: columns to take instead of the row's own."""
    each = [(fields or {}).get(n, F.col(n)).cast("string") for n in FIELDS]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in each)))


def depth(n: Column) -> Column:
    """Levels above n leaves."""
    return F.size(F.filter(F.array(*(F.lit(WIDTH**k).cast("long") for k in range(39))), lambda p: p < n))


def packs(nodes: DataFrame, below: int, payload: list[str]) -> DataFrame:
    """grp, pack, n, items (pos, hash and payload in order), preimages (of each level of the pack) and
    top, the pack's own node, of nodes(grp, pos, n, hash, payload) that are `below` levels above the leaves."""
    item = F.struct("pos", "hash", *payload)
    rows = nodes.withColumn("pack", div(F.col("pos"), SPAN)).groupBy("grp", "pack").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
    rows = rows.withColumn("levels", F.least(F.lit(LEVELS), F.greatest(F.lit(0), depth(F.col("n")) - below))).withColumn("h0", F.col("items.hash"))
    for k in range(1, LEVELS + 1):
        above, here = F.col("levels") >= k, F.col(f"h{k - 1}")
        firsts = F.sequence(F.lit(1), F.size(here), F.lit(WIDTH))
        rows = rows.withColumn(f"p{k}", F.when(above, F.transform(firsts, lambda i: F.array_join(F.slice(F.col(f"h{k - 1}"), i, WIDTH), ""))))  # noqa: B023
        rows = rows.withColumn(f"h{k}", F.when(above, F.transform(f"p{k}", digest)).otherwise(here))
    made = F.slice(F.array(*(f"p{k}" for k in range(1, LEVELS + 1))), 1, F.col("levels"))
    return rows.select("grp", "pack", "n", "items", made.alias("preimages"), F.col(f"h{LEVELS}")[0].alias("top"))


def path_in_pack(pos: Column, preimages: Column) -> Column:
    """A node's slot in, and the preimage of, each ancestor within its pack."""
    at = F.pmod(pos, F.lit(SPAN))
    power = F.array(*(F.lit(WIDTH**k).cast("long") for k in range(LEVELS + 1)))
    levels = F.filter(F.array(*(F.lit(k) for k in range(1, LEVELS + 1))), lambda k: k <= F.size(preimages))
    step = lambda k: F.struct(F.pmod(div(at, F.get(power, k - 1)), F.lit(WIDTH)).cast("int").alias("slot"), F.get(F.get(preimages, k - 1), div(at, F.get(power, k)).cast("int")).alias("preimage"))
    return F.transform(levels, step)


def siblings(path: Column) -> Column:
    """The other children's hashes, a string for each level: the preimage without the node's own slot."""
    return F.transform(path, lambda s: F.concat(F.substring(s["preimage"], F.lit(1), s["slot"] * HEX), F.substring(s["preimage"], s["slot"] * HEX + HEX + 1, F.lit(HEX * WIDTH))))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and a path give: its hash is spliced into each preimage in turn."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.overlay(s["preimage"], h, s["slot"] * HEX + 1, F.lit(HEX))))


@dataclass
class Tree:
    """packs: from the leaves up; tops: grp, hash of each group's last node."""

    packs: list[DataFrame]
    tops: DataFrame

    def paths(self, above: DataFrame) -> DataFrame:
        """The leaves' payload, hash and path, with what above(grp, path, others) tells of their group."""
        told = [c for c in above.columns if c not in ("grp", "path")]
        upper = above.withColumn("pos", F.lit(0).cast("long"))
        for rows in reversed(self.packs):
            upper = upper.select(F.col("grp").alias("u_grp"), F.col("pos").alias("u_pos"), F.col("path").alias("u_path"), *told)
            met = rows.join(upper, (F.col("grp") == F.col("u_grp")) & (F.col("pack") == F.col("u_pos")))
            own = F.transform("items", lambda x: F.struct(x.alias("item"), F.concat(path_in_pack(x["pos"], F.col("preimages")), F.col("u_path")).alias("path")))
            upper = met.select("grp", *told, F.inline(own)).select("grp", *told, "item.*", "path")
        return upper


def tree(nodes: DataFrame, payload: list[str]) -> Tree:
    """The tree over nodes(grp, pos, n, hash, payload) of each grp; its packs are written and stay."""
    most = nodes.agg(F.max(depth(F.col("n"))).alias("d")).first()["d"] or 0
    made, below = [], 0
    while not made or below < most:
        made.append(stash(packs(nodes, below, payload), "packs"))
        nodes, payload, below = made[-1].select("grp", F.col("pack").alias("pos"), "n", F.col("top").alias("hash")), [], below + LEVELS
    return Tree(made, nodes.select("grp", "hash"))


@dataclass
class Manifest:
    """documents: a tree for each source; sources: the tree over their roots; root: its hash, null if there are no rows."""

    documents: Tree
    sources: Tree
    root: str | None


def manifest(docs: DataFrame, claim: dict[str, Column] | None = None, claimed: Column | None = None) -> Manifest:
    """The manifest of docs. claim: columns in place of the row's own, for what is held against the
    manifest where `claimed` is true; it is hashed in the same pass as the row."""
    ready(docs.sparkSession)
    other = F.when(claimed, leaf(claim)) if claim else F.lit(None).cast("string")
    group = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # sorts as the source does, null first
    rows = docs.select("doc_id", "source", group.alias("grp"), leaf().alias("hash"), other.alias("other"))
    with Scratch(docs.sparkSession) as keep:
        each = tree(placed(keep(rows, "leaves"), keep, "doc_id", "hash"), ["doc_id", "source", "other"])
        subs = each.tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash")
        top = tree(placed(keep(subs, "subroots"), keep, "name"), ["name"])
    root = top.tops.first()
    return Manifest(each, top, root and root["hash"])


def prove(made: Manifest) -> DataFrame:
    """doc_id, source, leaf, subroot, root, siblings (a string for each level), folded_root (of the
    claim, where there is one) and verified, for each row of the manifest."""
    root = F.lit(made.root).cast("string")
    start = made.sources.tops.select("grp", F.array().cast(PATH).alias("path"))
    above = made.sources.paths(start).select(F.col("name").alias("grp"), F.col("hash").alias("subroot"), "path")
    rows = made.documents.paths(above).withColumn("folded_root", folded(F.col("path"), F.coalesce("other", "hash")))
    return rows.select("doc_id", "source", F.col("hash").alias("leaf"), "subroot", root.alias("root"), siblings(F.col("path")).alias("siblings"), "folded_root", (F.col("folded_root") == root).alias("verified"))
