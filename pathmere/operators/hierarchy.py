"""Parent-pointer hierarchies: path resolution, children, hard links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmere.functions.paths import norm_path, path_key, segment_ref, strip
from pathmere.session import cut_lineage


def _usable(name: Column) -> Column:
    return F.coalesce((strip(name) != "") & (name != "."), F.lit(False))


def resolve_directories(directories: DataFrame, root_id: int | None = None, root_path: str = "") -> DataFrame:
    """Full path per directory from (id, parent_id, name), parents in any order.

    Pointer doubling: each round replaces a row's pointer by its pointer's pointer, so a tree
    of depth d takes about log2(d) joins. Rows that reached a root leave the loop. Rows on or
    below a cycle or a missing parent never arrive and are left out; the loop ends as soon as
    a round resolves nothing. ``id`` must be unique (see ``last_entry_per_reference``).
    """
    root_ref = F.lit(root_id).cast("long")
    is_root = F.coalesce(
        (F.col("id") == F.col("parent_id")) | (F.col("id") == root_ref) | (F.col("name") == "."), F.lit(False)
    )
    below_root = F.coalesce(F.col("parent_id") == root_ref, F.lit(False))
    start = directories.where(is_root | _usable(F.col("name"))).select(
        "id",
        F.when(~is_root & ~below_root, F.col("parent_id")).alias("up"),
        F.when(is_root, F.lit(root_path)).when(below_root, F.concat(F.lit(root_path + "/"), "name"))
        .otherwise(F.col("name")).alias("tail"),
    )
    state = cut_lineage(start)
    unresolved = state.where("up is not null").count()
    while unresolved:
        moving = state.where("up is not null").alias("r")
        target = state.select(
            F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("tail").alias("_tail")
        )
        # each pointer meets one row, so the output never grows; a parent shared by very many
        # rows makes a skewed join key, which adaptive execution splits
        moved = moving.join(target, F.col("r.up") == F.col("_id")).select(
            "id", F.col("_up").alias("up"), F.concat("_tail", F.lit("/"), "tail").alias("tail")
        )
        state = cut_lineage(state.where("up is null").unionByName(moved))
        left = state.where("up is not null").count()
        if left == unresolved:
            break
        unresolved = left
    return state.where("up is null").select("id", F.col("tail").alias("full_path"))


def resolve_paths(
    entries: DataFrame,
    directories: DataFrame | None = None,
    root_id: int | None = None,
    root_path: str = "",
    strict: bool = False,
) -> DataFrame:
    """Entries (id, parent_id, name, is_directory, ...) with ``full_path``; unresolved rows drop out.

    Only directories enter the pointer loop; files join their folder once. ``strict`` turns
    unresolved rows into an error, except metadata rows whose name starts with ``$``.
    """
    entries = entries.withColumns({"id": segment_ref(F.col("id")), "parent_id": segment_ref(F.col("parent_id"))})
    if directories is None:
        directories = entries.where("is_directory").groupBy("id").agg(
            F.max_by("parent_id", F.struct("parent_id", "name")).alias("parent_id"),
            F.max_by("name", F.struct("parent_id", "name")).alias("name"),
        )
    else:
        directories = directories.withColumns(
            {"id": segment_ref(F.col("id")), "parent_id": segment_ref(F.col("parent_id"))}
        )
    folders = resolve_directories(directories.select("id", "parent_id", "name"), root_id, root_path)
    own = folders.select(F.col("id").alias("_own"), F.col("full_path").alias("_own_path"))
    parent = folders.select(F.col("id").alias("_parent"), F.col("full_path").alias("_parent_path"))
    root_ref = F.lit(root_id).cast("long")
    folder_path = F.when(F.coalesce(F.col("parent_id") == root_ref, F.lit(False)), F.lit(root_path)).otherwise(
        F.col("_parent_path")
    )
    placed = (
        entries.join(own, F.col("is_directory") & (F.col("id") == F.col("_own")), "left")
        .join(parent, ~F.col("is_directory") & (F.col("parent_id") == F.col("_parent")), "left")
        .withColumn(
            "full_path",
            F.when(F.col("is_directory"), F.col("_own_path")).when(
                _usable(F.col("name")), F.concat(folder_path, F.lit("/"), F.col("name"))
            ),
        )
        .drop("_own", "_own_path", "_parent", "_parent_path")
    )
    if strict:
        lost = placed.where("full_path is null and not startswith(coalesce(name, ''), '$')")
        sample = lost.select("id", "parent_id", "name").head(1)
        if sample:
            raise ValueError(f"unresolved record {sample[0].asDict()}")
    return placed.where("full_path is not null")


def last_entry_per_reference(entries: DataFrame, order: str = "usn") -> DataFrame:
    """The latest entry of every reference; ``max_by`` combines on the map side."""
    ref = segment_ref(F.col("ref"))
    fields = [c for c in entries.columns if c != "ref"]
    best = entries.groupBy(ref.alias("ref")).agg(F.max_by(F.struct(*fields), order).alias("r"))
    return best.select("ref", "r.*")


def with_parent_row(catalog: DataFrame) -> DataFrame:
    """Each row with its parent's path, kind and reference (null at the top)."""
    parent = catalog.select(
        F.col("path_key").alias("_pk"),
        F.col("full_path").alias("parent_full_path"),
        F.col("file_reference").alias("parent_reference"),
        F.col("structural").alias("parent_structural"),
    )
    return catalog.join(parent, F.col("parent_key") == F.col("_pk"), "left").drop("_pk")


def children_of(catalog: DataFrame, folders: DataFrame) -> DataFrame:
    """Direct children of the given folders (column ``path``)."""
    keys = folders.select(path_key(norm_path(F.col("path"))).alias("parent_key")).distinct()
    return catalog.join(keys, "parent_key", "left_semi")


def child_counts(catalog: DataFrame) -> DataFrame:
    """Children, files and bytes per folder; partial sums are built before the shuffle."""
    return catalog.groupBy("parent_key").agg(
        F.count("*").alias("children"),
        F.count_if(~F.col("is_directory")).alias("files"),
        F.min("path_key").alias("first_child"),
        F.max("path_key").alias("last_child"),
    )


def child_list(catalog: DataFrame) -> DataFrame:
    """Children as ordered rows (parent_key, path_key).

    The list of a folder stays as rows in sorted files instead of one array: a folder may hold
    any share of the catalog.
    """
    return catalog.select("parent_key", "path_key", "name", "is_directory").repartitionByRange(
        "parent_key", "path_key"
    ).sortWithinPartitions("parent_key", "path_key")


# --- hard links ------------------------------------------------------------------------

# Namespaces of stored names.
LONG_NAMESPACES = ["win32", "win32_and_dos"]
SHORT_NAMESPACE = "dos"


def collect_names(records: DataFrame) -> DataFrame:
    """One row per stored name of a base record, including names held by its extension records.

    ``records``: ref, names array<struct(parent, name, namespace)>, ext_refs array<long>.
    """
    names = records.select("ref", F.explode("names").alias("n"))
    refs = records.select(F.col("ref").alias("base"), F.explode("ext_refs").alias("ext"))
    foreign = (
        refs.where("ext <> base")
        .join(names, F.col("ext") == F.col("ref"))
        .select(F.col("base").alias("ref"), "n")
    )
    return names.unionByName(foreign).select("ref", "n.parent", "n.name", "n.namespace")


def indexable_names(names: DataFrame) -> DataFrame:
    """Long names when the record has one, else everything but short aliases.

    The per-record flag is an aggregate joined back, so a record with very many names is
    neither sorted nor buffered.
    """
    is_long = F.col("namespace").isin(LONG_NAMESPACES)
    long_refs = names.where(is_long).select("ref").distinct().withColumn("_long", F.lit(True))
    joined = names.join(long_refs, "ref", "left")
    keep = F.when(F.col("_long"), is_long).otherwise(F.col("namespace") != SHORT_NAMESPACE)
    return joined.where(keep).drop("_long")


def link_paths(names: DataFrame, folders: DataFrame) -> DataFrame:
    """One row and path per hard link; ``folders`` is (id, full_path)."""
    parent = folders.select(F.col("id").alias("_id"), F.col("full_path").alias("_folder"))
    return (
        names.where(_usable(F.col("name")))
        .join(parent, F.col("parent") == F.col("_id"))
        .withColumn("full_path", F.concat("_folder", F.lit("/"), "name"))
        .drop("_id", "_folder")
    )
