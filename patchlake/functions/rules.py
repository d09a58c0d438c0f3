"""Curation rules compiled to Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchlake.functions import text as X

# Default rules.
EXCLUDE_GLOBS = ("l10n_*", "point_of_sale", "pos_*", "spreadsheet*", "payment_*")
ALLOW_GLOBS = (
    "l10n_de*",
    "l10n_ch*",
    "payment_custom",
    "payment_paypal",
    "payment_novalnet",
    "payment_novalnet_ext",
    "payment_sepa_direct_debit",
)
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock")
ASSET_EXTENSIONS = ("js", "css", "scss", "less")
ASSET_MAX_CHARS = 2000
COMMIT_MAX_CHARS = 24000
SKIP_TAGS = ("MERGE",)

_GLOB_CHARS = re.compile(r"[*?\[]")


def glob_to_regex(glob: str) -> str:
    """Anchored Java regex of a shell glob; `*` also crosses `/`."""
    out, i = [], 0
    while i < len(glob):
        ch, i = glob[i], i + 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and (end := glob.find("]", i + 1 + glob.startswith("!", i))) > 0:
            negated, body = glob[i] == "!", glob[i:end]
            body = re.sub(r"([^\w-])", r"\\\1", body[1:] if negated else body)
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end + 1
        else:
            out.append(re.sub(r"([^\w])", r"\\\1", ch))
    return "(?s)^" + "".join(out) + r"\z"


def matches_any(value: Column, globs: tuple[str, ...]) -> Column:
    """True when one glob covers the whole value. Plain names and prefixes need no regex."""
    names = [g for g in globs if not _GLOB_CHARS.search(g)]
    prefixes = [g[:-1] for g in globs if g.endswith("*") and not _GLOB_CHARS.search(g[:-1])]
    rest = [g for g in globs if g not in names and g[:-1] not in prefixes]
    tests = [value.startswith(p) for p in prefixes] + [value.rlike(glob_to_regex(g)) for g in rest]
    if names:
        tests.append(value.isin(names))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


@dataclass(frozen=True)
class Rules:
    """What a corpus keeps. `installed=None` means: do not restrict to a module list."""

    exclude: tuple[str, ...] = EXCLUDE_GLOBS
    allow: tuple[str, ...] = ALLOW_GLOBS
    lockfiles: tuple[str, ...] = LOCKFILES
    skip_pot: bool = True
    skip_i18n_po: bool = True
    skip_static_lib: bool = True
    skip_minified: bool = True
    asset_extensions: tuple[str, ...] = ASSET_EXTENSIONS
    asset_max_chars: int | None = ASSET_MAX_CHARS  # None: no cap
    commit_max_chars: int | None = COMMIT_MAX_CHARS
    skip_tags: tuple[str, ...] = SKIP_TAGS
    roots: tuple[str, ...] = (".",)
    module_root: str = "addons/"
    core_root: str = "core/"
    core_module: str = "core"
    installed: frozenset[str] | None = field(default=None)

    def only_installed(self, names) -> "Rules":
        names = frozenset(names)
        if not names:
            raise ValueError("the installed-module list is empty: every module would be dropped")
        return replace(self, installed=names)

    def module_of(self, path: Column) -> Column:
        return X.module_of(path, self.module_root, self.core_root, self.core_module)

    def module_excluded(self, module: Column, installed: Column | None = None) -> Column:
        """Core is kept, then allow wins over exclude, then the installed list decides.

        `installed` may be a boolean column from a join with a module table.
        """
        if installed is None and self.installed is not None:
            installed = module.isin(sorted(self.installed))
        missing = F.lit(False) if installed is None else ~installed
        return (
            F.when(module == self.core_module, F.lit(False))
            .when(matches_any(module, self.allow), F.lit(False))
            .when(matches_any(module, self.exclude), F.lit(True))
            .otherwise(missing)
        )

    def file_skipped(self, path: Column) -> Column:
        base = X.base_name(path)
        tests = []
        if self.skip_pot:
            tests.append(path.endswith(".pot"))
        if self.skip_i18n_po:
            tests.append(path.contains("/i18n/") & path.endswith(".po"))
        if self.skip_static_lib:
            tests.append(path.contains("/static/lib/"))
        if self.skip_minified:
            tests.append(base.contains(".min."))
        if self.lockfiles:
            tests.append(base.isin(list(self.lockfiles)))
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    def in_roots(self, path: Column) -> Column:
        if any(root in (".", "", "./") for root in self.roots):
            return F.lit(True)
        roots = [root.removesuffix("/") for root in self.roots]
        return reduce(lambda a, b: a | b, [(path == root) | path.startswith(root + "/") for root in roots])

    def tag_skipped(self, subject: Column) -> Column:
        return F.coalesce(X.subject_tag(subject).isin(list(self.skip_tags)), F.lit(False))

    def cap_asset(self, path: Column, block: Column) -> Column:
        """Oversized asset blocks shrink to their first line and a note."""
        if self.asset_max_chars is None:
            return block
        ext, size = X.extension(path), F.length(block)
        note = F.concat(
            X.first_line(block),
            F.lit("\n[diff omitted: "),
            size.cast("string"),
            F.lit(f" chars > {self.asset_max_chars} ("),
            ext,
            F.lit(" asset)]\n"),
        )
        oversized = ext.isin(list(self.asset_extensions)) & (size > self.asset_max_chars)
        return F.when(oversized, note).otherwise(block)

    def cap_commit(self, diff_text: Column) -> Column:
        if self.commit_max_chars is None:
            return diff_text
        note = F.lit(f"\n[commit diff truncated at {self.commit_max_chars} chars]\n")
        cut = F.concat(F.substring(diff_text, 1, self.commit_max_chars), note)
        return F.when(F.length(diff_text) > self.commit_max_chars, cut).otherwise(diff_text)
