"""Look-alike stills and videos, and the groups that they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm.components import connected_components
from reelsift.operators.current import known
from reelsift.operators.similarity import HOT_BUCKET, block_keys, frame_links, frame_runs, hamming_links, hash_bits
from reelsift.shared import materialize


def numbered(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` with BIGINT ``node``, unique but in no order; written at once, since the numbers hold for one evaluation only."""
    return materialize(nodes.withColumn("node", F.monotonically_increasing_id()), name)


class Graph:
    """Records reduced to nodes, and links between nodes that match.

    ``members`` has (node, n_records, primary), n_records that of the node; records of one node match each other.
    """

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links

    def moved(self, by: int) -> Graph:
        """The same with other numbers, to stand beside another graph."""
        shift = lambda df, *cs: df.withColumns({c: F.col(c) + F.lit(by) for c in cs})
        return Graph(shift(self.members, "node"), shift(self.links, "a", "b"))

    def beside(self, other: Graph) -> Graph:
        return Graph(self.members.unionByName(other.members), self.links.unionByName(other.links))

    def groups(self) -> DataFrame:
        """(group_key, primary) of all records with a match; group_key is the least primary linked to it."""
        of = connected_components(self.links)
        found = self.members.join(of, "node", "left").where("component IS NOT NULL OR n_records > 1").select("primary", F.coalesce("component", "node").alias("component"))
        found = materialize(found, "linked")
        return found.join(found.groupBy("component").agg(F.min("primary").alias("group_key")), "component").select("group_key", "primary")


def still_graph(stills: DataFrame, threshold: int = 6, hot: int = HOT_BUCKET) -> Graph:
    """Stills that look alike.

    ``stills`` (primary, root, device, subtype, phash) has one row per primary.  Two match if root, device (trimmed,
    all unknown ones equal) and subtype are equal and their hashes differ in at most ``threshold`` bits.  A null or
    malformed hash matches nothing.  Copies of a hash are one node, so they are never paired with each other.
    """
    rows = stills.select("primary", "root", known("device").alias("device"), "subtype", hash_bits(F.col("phash")).alias("bits")).where("bits IS NOT NULL AND primary IS NOT NULL")
    records = materialize(rows.select("primary", "bits", *[c.alias(k) for k, c in block_keys(["root", "device", "subtype"]).items()]), "stills")
    nodes = numbered(records.groupBy("g", "g2", "bits").agg(F.count(F.lit(1)).alias("n_records")), "still-nodes")
    return Graph(records.join(nodes, ["g", "g2", "bits"]).select("node", "n_records", "primary"), hamming_links(nodes, ["g", "g2"], "bits", "node", threshold, hot))


def video_graph(videos: DataFrame, threshold: int = 6, share: float = 0.2, hot: int = HOT_BUCKET) -> Graph:
    """Videos that look alike.

    ``videos`` (primary, root, duration, phashes, error) has one row per primary.  Two match if root is equal, both have
    as many frame hashes (at least one), error is null, durations differ by at most ``share`` of the longer, and
    the mean of the bit differences frame by frame is at most ``threshold``.  Null, empty or malformed hashes and
    durations that are null, negative or no number match nothing.

    One node stands for all videos of a root with the same hashes whose durations form a chain without a gap beyond
    ``share``: such videos are linked anyway, and two chains hold a matching pair just where their ranges come near
    enough.
    """
    bits = F.transform("phashes", lambda x: hash_bits(x))
    rows = (
        videos.where("error IS NULL AND primary IS NOT NULL")
        .select("primary", "root", F.col("duration").cast("double").alias("duration"), bits.alias("bits"))
        .where((F.size("bits") > 0) & ~F.exists("bits", lambda x: x.isNull()) & (F.col("duration") >= 0) & ~F.isnan("duration") & (F.col("duration") < float("inf")))
    )
    records = materialize(rows.select("primary", "bits", "duration", *[c.alias(k) for k, c in block_keys(["root"]).items()]), "videos")
    lengths = materialize(frame_runs(records, share), "video-lengths")
    nodes = numbered(lengths.groupBy("g", "g2", "bits", "run").agg(F.sum("n").alias("n_records"), F.min("duration").alias("lo"), F.max("duration").alias("hi")), "video-nodes")
    of_length = lengths.select("g", "g2", "bits", "duration", "run").join(nodes.select("g", "g2", "bits", "run", "node", "n_records"), ["g", "g2", "bits", "run"])
    return Graph(records.join(of_length, ["g", "g2", "bits", "duration"]).select("node", "n_records", "primary"), frame_links(nodes, threshold, share, hot))


def lookalike_groups(stills: DataFrame, videos: DataFrame, threshold: int = 6, share: float = 0.2) -> DataFrame:
    """(group_key, primary) of stills and of videos that look like another one, consolidated in one run.

    One row per record with a match, see :func:`still_graph` and :func:`video_graph`; empty tables give no rows.
    """
    # Numbers of nodes stay far below 2 ** 61.
    return still_graph(stills, threshold).beside(video_graph(videos, threshold, share).moved(1 << 61)).groups()
