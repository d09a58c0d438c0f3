"""Curation: patch -> file blocks -> rules -> one capped document per commit.

Everything up to the document happens inside the row, so curation adds no
shuffle; only the row forms (`explode_blocks`) multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.functions import text as X
from patchlake.functions.arrays import explode_rows, let, posexplode_rows
from patchlake.functions.bounds import broadcast_if_small
from patchlake.functions.rules import Rules

# Fixed value: how a file block starts, at the start of a line.
BLOCK_START = "diff --git "
# Matched against the first line only, which is all the header can span.
BLOCK_HEADER = rf"(?dU)^{BLOCK_START}a/(.+?) b/([^{X.SPACE_CLASS}]+)"


def _raw_blocks(patch: Column) -> Column:
    """Block texts; what comes before the first marker is dropped.

    The patch is cut at line end + marker, a plain text that the matcher finds
    by skipping ahead, and both are put back. A look-ahead at every line start
    takes three times as long.
    """

    def rebuilt(pieces: Column) -> Column:
        n_blocks = F.size(pieces) - 1
        blocks = F.slice(pieces, F.lit(2), F.size(pieces))

        def block(piece: Column, i: Column) -> Column:
            line_end = F.when(i < n_blocks - 1, F.lit("\n")).otherwise(F.lit(""))
            return F.concat(F.lit(BLOCK_START), piece, line_end)

        return F.transform(blocks, block)

    return let(F.split(F.concat(F.lit("\n"), patch), "\n" + BLOCK_START), rebuilt)


def _block_path(block: Column) -> Column:
    """New path, the old one for deleted files, '' when the header does not parse."""
    line = X.first_line(block)
    new = F.regexp_extract(line, BLOCK_HEADER, 2)
    return F.when(new == "dev/null", F.regexp_extract(line, BLOCK_HEADER, 1)).otherwise(new)


def file_blocks(patch: Column, rules: Rules) -> Column:
    """ARRAY<STRUCT<path, module, block>> in patch order."""
    with_path = F.transform(_raw_blocks(patch), lambda b: F.struct(_block_path(b).alias("path"), b.alias("block")))
    parsed = F.filter(with_path, lambda x: x["path"] != "")
    return F.transform(
        parsed,
        lambda x: F.struct(
            x["path"].alias("path"), rules.module_of(x["path"]).alias("module"), x["block"].alias("block")
        ),
    )


def n_unparsed_blocks(patch: Column) -> Column:
    """Blocks whose header does not parse (blank or quoted paths) and so are dropped."""
    return F.size(F.filter(_raw_blocks(patch), lambda b: _block_path(b) == ""))


def keeps(path: Column, module: Column, rules: Rules, installed: Column | None = None) -> Column:
    return ~rules.module_excluded(module, installed) & ~rules.file_skipped(path) & rules.in_roots(path)


def kept_blocks(patch: Column, rules: Rules) -> Column:
    """Blocks that pass the rules, oversized assets cut to a note."""
    kept = F.filter(file_blocks(patch, rules), lambda x: keeps(x["path"], x["module"], rules))
    return F.transform(
        kept,
        lambda x: F.struct(
            x["path"].alias("path"),
            x["module"].alias("module"),
            rules.cap_asset(x["path"], x["block"]).alias("block"),
        ),
    )


def explode_blocks(commits: DataFrame, rules: Rules, *keys: str) -> DataFrame:
    """One row per file block: (keys, pos, path, module, block)."""
    keys = keys or ("sha",)
    rows = posexplode_rows(commits, file_blocks(F.col("patch"), rules), "b", *keys)
    return rows.select(*keys, "pos", "b.path", "b.module", "b.block")


def curate(commits: DataFrame, rules: Rules, source: str | Column | None = None) -> DataFrame:
    """Curated documents of parsed commits (`sources.changelog.parse_records`).

    Skipped tags go first, before any patch is split. The kept blocks are
    computed once: the generator that drops commits without content also keeps
    Catalyst from copying the block pipeline into every column that uses it.
    """
    has_source = "source" in commits.columns
    label = F.lit(source) if isinstance(source, str) else source
    if label is None:
        label = F.col("source") if has_source else F.lit(None).cast("string")
    base = commits.where(~rules.tag_skipped(F.col("subject"))).withColumn(
        "source", F.coalesce(label, F.lit("community"))
    )
    some = F.filter(F.array(kept_blocks(F.col("patch"), rules)), lambda blocks: F.size(blocks) > 0)
    kept = explode_rows(base, some, "kept", *[c for c in base.columns if c != "patch"])
    parts = kept.select(
        *[c for c in kept.columns if c != "kept"],
        X.subject_tag(F.col("subject")).alias("tag"),
        F.sort_array(F.array_distinct(F.col("kept.module"))).alias("modules"),
        F.col("kept.path").alias("files"),
        F.size("kept").alias("n_files"),
        let(F.array_join(F.col("kept.block"), ""), rules.cap_commit).alias("diff_text"),
    )
    text = F.concat(
        F.lit("modules: "),
        F.array_join("modules", ", "),
        F.lit("\n"),
        F.coalesce("subject", F.lit("")),
        F.lit("\n\n"),
        F.coalesce("body", F.lit("")),
        F.lit("\n\n"),
        F.col("diff_text"),
    )
    # It starts with a word, so only its end can need stripping.
    return parts.withColumn("doc_text", F.rtrim(text, F.lit(X.WHITESPACE)))


def touched_modules(commits: DataFrame, rules: Rules, *keys: str) -> DataFrame:
    """(keys, modules): the distinct modules of each commit, for joins that need no patch."""
    modules = F.transform(file_blocks(F.col("patch"), rules), lambda b: b["module"])
    return commits.select(*(keys or ("sha",)), F.array_distinct(modules).alias("modules"))


def module_dim(commits: DataFrame, rules: Rules) -> DataFrame:
    """Every module the corpus touches, with the verdict of the rules; of commits or their `touched_modules`."""
    touched = commits if "patch" not in commits.columns else touched_modules(commits, rules)
    modules = explode_rows(touched, F.col("modules"), "module").distinct()
    return modules.withColumn("excluded", rules.module_excluded(F.col("module")))


def keep_installed(blocks: DataFrame, installed: DataFrame, rules: Rules) -> DataFrame:
    """Row form of the installed-only rule: block rows against a module table."""
    dim = broadcast_if_small(installed.select("module", F.lit(True).alias("is_installed")).distinct())
    joined = blocks.join(dim, "module", "left")
    flag = F.coalesce("is_installed", F.lit(False))
    return joined.where(~rules.module_excluded(F.col("module"), flag)).drop("is_installed")
