"""Change events: flag bits, classification, metadata impact and the replay floor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The platform's published bits, from 1 up; journals are read as they are.
FLAGS = {
    name: 1 << i
    for i, name in enumerate(
        "must_scan user_dropped kernel_dropped ids_wrapped history_done root_changed mount unmount created removed inode_meta renamed "
        "modified finder_info owner xattr is_file is_dir is_symlink own_event hardlink last_hardlink cloned".split()
    )
}
KNOWN = (1 << len(FLAGS)) - 1


def bits(*names: str) -> int:
    out = 0
    for n in names:
        out |= FLAGS[n]
    return out


TYPES = bits("is_file", "is_dir", "is_symlink")
CONTENT = bits("modified", "inode_meta", "xattr", "finder_info", "owner")
LOST = bits("user_dropped", "kernel_dropped", "ids_wrapped", "root_changed")
#: What can tell of a change of sizes or times, and what can't unless the object's type is unknown.
WRITES = bits("created", "removed", "renamed", "modified", "inode_meta")
ANCILLARY = bits("xattr", "finder_info", "owner", "own_event", "hardlink", "last_hardlink", "cloned")
#: Ids that say nothing about order.
UNRELIABLE_LOW, UNRELIABLE_HIGH = 0, 2**63 - 1


def any_of(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask).cast("long")) != 0


def all_of(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask).cast("long")) == mask


def unknown_bits(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(~KNOWN).cast("long")) != 0


def one_type(flags: Column) -> Column:
    return F.bit_count(flags.bitwiseAND(F.lit(TYPES).cast("long"))) == 1


def type_name(flags: Column) -> Column:
    return F.when(any_of(flags, FLAGS["is_file"]), "file").when(any_of(flags, FLAGS["is_dir"]), "directory").otherwise("symlink")


def classify(flags: Column) -> Column:
    """What an event means for names. The first rule that holds decides."""
    f = flags
    return (
        F.when(any_of(f, LOST), "invalidated")
        .when(any_of(f, FLAGS["must_scan"]), "subtree_dirty")
        .when(any_of(f, FLAGS["history_done"]), "history_done")
        .when(any_of(f, bits("mount", "unmount")), "ambiguous")
        .when(any_of(f, FLAGS["renamed"]) | all_of(f, bits("created", "removed")), "ambiguous")
        .when(unknown_bits(f), "ambiguous")
        .when(any_of(f, FLAGS["removed"]), "simple_remove")
        .when(any_of(f, FLAGS["created"]), F.when(one_type(f), F.concat(F.lit("simple_create:"), type_name(f))).otherwise("ambiguous"))
        .when(any_of(f, CONTENT), F.when(one_type(f), "content_only").otherwise("ambiguous"))
        .otherwise("ambiguous")
    )


def impact(flags: Column) -> Column:
    """What an event means for sizes and times, apart from what it means for names."""
    f = flags
    return (
        F.when(any_of(f, LOST | bits("mount", "unmount")), "invalidated")
        .when(any_of(f, FLAGS["must_scan"]), "reconcile_parent")
        .when(any_of(f, FLAGS["history_done"]), "none")
        .when(unknown_bits(f) | all_of(f, bits("created", "removed")), "reconcile_parent")
        .when(any_of(f, FLAGS["removed"]), "remove")
        .when(any_of(f, WRITES), F.when(any_of(f, bits("is_dir", "is_symlink")), "refresh_time").otherwise("refresh_size_and_time"))
        .when(any_of(f, ANCILLARY) & ~any_of(f, TYPES), "reconcile_parent")  # may hide that a name came to be
        .otherwise("none")
    )


def is_ordinary(flags: Column) -> Column:
    """Simple creates and removals, content changes of a known type and pure renames; only these may be skipped in a replay."""
    kind = classify(flags)
    rename_only = any_of(flags, FLAGS["renamed"]) & (flags.bitwiseAND(F.lit(~(FLAGS["renamed"] | TYPES)).cast("long")) == 0)
    return kind.startswith("simple_") | (kind == "content_only") | rename_only


def is_replayed(flags: Column, event_id: Column, floor: int) -> Column:
    """An ordinary event with a reliable id at or below the floor. Lateness goes by id, never by a watermark."""
    return is_ordinary(flags) & (event_id > UNRELIABLE_LOW) & (event_id < UNRELIABLE_HIGH) & (event_id <= floor)


def failure_policy(error: Column, at_root: Column) -> Column:
    """What to do when a listing fails with an error name."""
    return (
        F.when(error == "ECANCELED", "cancelled")
        .when(error.isin("EACCES", "EPERM", "ENODATA"), "preserve")
        .when(at_root, "rebuild")
        .when(error.isin("ENOENT", "ENOTDIR", "ELOOP", "EXDEV"), "retry_parent")
        .otherwise("rebuild")
    )


def concerns(path: Column, flags: Column, root: str, excluded: list[str]) -> Column:
    """Whether an event belongs to a root: it is within it, and not in an excluded folder unless it carries a special bit."""
    from canopy.functions.paths import is_within

    own = F.lit(False)
    for x in excluded:
        own = own | is_within(path, F.lit(x))
    special = any_of(flags, LOST | bits("must_scan", "history_done", "mount", "unmount"))
    return is_within(path, F.lit(root)) & (special | ~own)


def rooted(path: Column, flags: Column, root: str) -> Column:
    """Paths as the source tells them: device-relative ones get the root before them, and lost history concerns the root itself."""
    base = "" if root == "/" else root
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path))
    return F.when(any_of(flags, LOST | FLAGS["history_done"]), F.lit(root)).otherwise(full)
