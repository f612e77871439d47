"""From files to items: grouping, pairing, companions, backups, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.config import CONFIG, Config
from reelsift.functions.media import classify, image_rank, parent_of, stem_of
from reelsift.operators.components import component_labels


def with_keys(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``cls``, ``parent`` and ``stem_l``, by which files of a folder belong together."""
    p = F.col(path)
    return files.withColumns({"cls": classify(p), "parent": parent_of(p), "stem_l": F.lower(stem_of(p))})


def folder_groups(files: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, parent, stem_l) of images and raw files: mixed, image_only or raw_only, with counts."""
    photos = files.where(F.col("cls").isin("image", "raw"))
    g = photos.groupBy(*keys, "parent", "stem_l").agg(F.count_if(F.col("cls") == "image").alias("n_images"), F.count_if(F.col("cls") == "raw").alias("n_raws"))
    return g.withColumn("shape", F.when((F.col("n_images") > 0) & (F.col("n_raws") > 0), "mixed").when(F.col("n_images") > 0, "image_only").otherwise("raw_only"))


def greedy_match(left: DataFrame, right: DataFrame, keys: list[str], left_order: list, right_order: list) -> DataFrame:
    """One-to-one: the k-th left row of a key takes the k-th right row of it, which is what greedy taking by order does.

    Rows with nulls in keys match each other, as equal keys do.  Rows without a partner are left out.  Columns of
    the right side come as a struct ``match``.
    """
    l = left.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*left_order)))
    r = right.select(*[F.col(k).alias(f"__r{k}") for k in keys], F.struct("*").alias("match"), F.row_number().over(Window.partitionBy(*keys).orderBy(*right_order)).alias("__rk"))
    cond = F.col("__k") == F.col("__rk")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r{k}"))
    return l.join(r, cond).drop("__k", "__rk", *[f"__r{k}" for k in keys])


def merge_by_shared_id(groups: DataFrame, group: str, shared: str) -> DataFrame:
    """(group, merged): groups that share a content id are one, transitively; named by the least of them.

    A group's ids are linked to the least group that has the id, so a hot id costs one edge per group.
    """
    ids = groups.where(F.col(shared).isNotNull() & (F.col(shared) != "")).select(F.col(group).alias("g"), F.col(shared).alias("s")).distinct()
    first = ids.groupBy("s").agg(F.min("g").alias("f"))
    labels = component_labels(ids.join(first, "s").where("g <> f").select(F.col("f").alias("a"), F.col("g").alias("b")))
    out = groups.select(F.col(group).alias("g")).distinct().join(labels, F.col("g") == F.col("node"), "left")
    return out.select(F.col("g").alias(group), F.coalesce("label", "g").alias("merged"))


def vendor_items(files: DataFrame, group: list[str], cfg: Config = CONFIG, vendor: Column | None = None) -> DataFrame:
    """(group, path, role, item): what each file of a vendor's group becomes.

    ``files`` has path, cls and duration.  The best image is an item, with other images, raws, sidecars and videos of at most
    ``live_max_s`` as companions; without an image the first raw is, with raws and sidecars.  Other videos are items;
    the first takes all proxies, and in a group of videos only the sidecars.  What is left is an orphan.  With a raw but no image, short
    videos are items, too.  role is item, companion or orphan; item is the path of the item a file belongs to.
    Where ``vendor`` is given and false, images rank as other cameras' do and every video is an item.
    """
    vendor = F.lit(True) if vendor is None else vendor
    w = Window.partitionBy(*group)
    f = files.withColumns({"n_img": F.count_if(F.col("cls") == "image").over(w), "n_raw": F.count_if(F.col("cls") == "raw").over(w)})
    live = vendor & (F.col("cls") == "video") & (F.col("n_img") > 0) & F.coalesce(F.col("duration") <= cfg.live_max_s, F.lit(False))
    f = f.withColumns({"live": live, "long": (F.col("cls") == "video") & ~live})
    name = F.substring_index("path", "/", -1)
    rank = F.when(F.col("cls") == "image", image_rank(F.col("path"), vendor)).otherwise(0)
    order = Window.partitionBy(*group, "cls", "live").orderBy(rank, name, "path")
    f = f.withColumn("nth", F.row_number().over(order))
    best_image = F.max(F.when((F.col("cls") == "image") & (F.col("nth") == 1), F.col("path"))).over(w)
    best_raw = F.max(F.when((F.col("cls") == "raw") & (F.col("nth") == 1), F.col("path"))).over(w)
    first_video = F.max(F.when(F.col("long") & (F.col("nth") == 1), F.col("path"))).over(w)
    f = f.withColumns({"image": best_image, "raw": best_raw, "video": first_video})
    still = F.coalesce("image", "raw")
    item = (
        F.when(F.col("cls").isin("image", "raw"), still)
        .when(F.col("live"), F.col("image"))
        .when(F.col("long"), F.col("path"))
        .when(F.col("cls") == "proxy", F.col("video"))
        .when(F.col("cls") == "sidecar", F.coalesce(still, F.col("video")))
    )
    role = F.when(item.isNull(), "orphan").when(item == F.col("path"), "item").otherwise("companion")
    return f.select(*group, "path", role.alias("role"), item.alias("item"))


def attach(primaries: DataFrame, extras: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(attached, orphans): extras given to the primary of equal keys, the least path if there are several; the rest."""
    first = primaries.groupBy(*keys).agg(F.min("path").alias("primary"))
    return extras.join(first, keys), extras.join(first.select(*keys), keys, "left_anti")


def backup_groups(files: DataFrame, signature: list[str], digest: str) -> DataFrame:
    """Copies: files of equal signature and content digest, with their keeper.

    In two steps, so that digests are only looked at where cheap signatures repeat.  Keeper: images with a raw (``mixed``) first,
    then images, then the least path.  Rows with a null signature or digest are no copies.
    """
    ok = files.where(F.concat(*[F.col(s).cast("string") for s in signature]).isNotNull())
    repeated = ok.groupBy(*signature).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*signature)
    cand = ok.join(repeated, signature, "left_semi").where(F.col(digest).isNotNull())
    score = F.struct(~F.coalesce("mixed", F.lit(False)), F.col("cls") != "image", F.col("path").alias("path"))
    return cand.groupBy(*signature, digest).agg(F.min(score).getField("path").alias("keeper"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")


def backup_items(files: DataFrame, signature: list[str], digest: str) -> DataFrame:
    """(primary, keeper, backups): items that are copies of another one, which stays, with the files that go to it as backups.

    ``files`` has primary, kind and mixed (of the item), path and the columns of ``signature`` and ``digest``.  Items that hold files of equal signature and digest are
    one set, transitively; of a set the item with a raw beside its image stays, then images, then the least path.  Rows with
    a null in signature or digest are no copies.  Digests are only looked at where signatures repeat.
    """
    ok = files.where(F.concat(*[F.col(s).cast("string") for s in signature]).isNotNull()).select("primary", *signature, digest).distinct()
    repeated = ok.groupBy(*signature).agg(F.count_distinct("primary").alias("c")).where("c > 1").select(*signature)
    cand = ok.join(repeated, signature, "left_semi").where(F.col(digest).isNotNull())
    first = cand.groupBy(*signature, digest).agg(F.min("primary").alias("first"))
    sets = component_labels(cand.join(first, [*signature, digest]).where("primary <> first").select(F.col("first").alias("a"), F.col("primary").alias("b")))
    score = F.struct(~F.coalesce("mixed", F.lit(False)), F.coalesce("kind", F.lit("")) != "image", F.col("primary").alias("primary"))
    members = files.select("primary", "kind", "mixed").distinct().join(sets.withColumnRenamed("node", "primary"), "primary")
    keeper = members.groupBy("label").agg(F.min(score).getField("primary").alias("keeper"))
    held = files.groupBy("primary").agg(F.array_sort(F.collect_set("path")).alias("backups"))
    return members.join(keeper, "label").where("primary <> keeper").select("primary", "keeper").join(held, "primary")


def expand_files(entries: DataFrame, primary: str = "primary", companions: str = "companions", backups: str | None = None) -> DataFrame:
    """One row per physical file of an entry: its primary, companions and backups, each once (``path``)."""
    lists = [F.array(primary), F.coalesce(companions, F.array().cast("array<string>"))] + ([F.coalesce(backups, F.array().cast("array<string>"))] if backups else [])
    return entries.withColumn("path", F.explode(F.array_distinct(F.concat(*lists))))


def with_shadows(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` (primary, path, ...) and, for each file that has one in ``manifest`` (path), its shadow '._name' beside it as a further row."""
    name = F.substring_index("path", "/", -1)
    shadow = F.concat(F.substring("path", F.lit(1), F.length("path") - F.length(name)), F.lit("._"), name)
    there = manifest.where(F.col("path").isNotNull() & F.substring_index("path", "/", -1).startswith("._")).select("path").distinct()
    return files.unionByName(files.where(~name.startswith("._")).withColumn("path", shadow).join(there, "path", "left_semi").select(*files.columns))
