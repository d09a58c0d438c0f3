import pytest
from pyspark.sql import functions as F

from patchlake.functions import text as X
from patchlake.functions.rules import Rules, glob_to_regex, matches_any
from patchlake.sources.files import read_module_list

RULES = Rules()

MODULES = {
    "l10n_fr": True, "l10n_de": False, "l10n_de_reports": False, "l10n_ch": False, "point_of_sale": True,
    "pos_restaurant": True, "postmark_mail_status": False, "spreadsheet": True, "spreadsheet_dashboard": True,
    "payment_stripe": True, "payment_paypal": False, "payment": False, "sale": False, "core": False,
}
PATHS = {
    "addons/sale/i18n/sale.pot": True, "addons/sale/i18n/de.po": True, "addons/web/static/lib/jquery/jquery.js": True,
    "addons/web/static/src/foo.min.js": True, "addons/web/package-lock.json": True,
    "addons/sale/models/sale_order.py": False, "i18n/de.po": False, "static/lib/x.js": False, "a.min.d/x.py": False,
}


def evaluate(spark, values, column):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r[0]: r[1] for r in df.select("v", column.alias("out")).collect()}


def test_modules(spark):
    assert evaluate(spark, MODULES, RULES.module_excluded(F.col("v"))) == MODULES


def test_paths(spark):
    assert evaluate(spark, PATHS, RULES.file_skipped(F.col("v"))) == PATHS


def test_flags_switch_skips_off(spark):
    rules = Rules(skip_pot=False, skip_i18n_po=False, skip_static_lib=False, skip_minified=False, lockfiles=())
    assert not any(evaluate(spark, PATHS, rules.file_skipped(F.col("v"))).values())


def test_module_of(spark):
    want = {"addons/sale/models/sale.py": "sale", "core/models.py": "core", "web_studio/x.py": "web_studio", "README": "README", "addons/x": "x"}
    assert evaluate(spark, want, RULES.module_of(F.col("v"))) == want


def test_installed_list(spark):
    rules = RULES.only_installed(["sale"])
    want = {"sale": False, "stock": True, "core": False, "payment_paypal": False, "l10n_fr": True}
    assert evaluate(spark, want, rules.module_excluded(F.col("v"))) == want
    with pytest.raises(ValueError):
        RULES.only_installed([])


def test_module_list_file(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# head\n\n  sale \n # not a comment\nstock\nsale\n")
    names = {r[0] for r in read_module_list(spark, str(tmp_path / "m.txt")).collect()}
    assert names == {"sale", "stock", "# not a comment"}


def test_tags(spark):
    want = {
        "[REF] sale: rework": "REF", "  [FIX] x": "FIX", " [A1_B] x": "A1_B", "x [FIX]": None, "[fix] x": None,
        "": None, "\n[IMP]": "IMP", "[]": None,
    }
    assert evaluate(spark, want, X.subject_tag(F.col("v"))) == want
    skipped = evaluate(spark, ["[MERGE] x", "[FIX] x", "x"], RULES.tag_skipped(F.col("v")))
    assert skipped == {"[MERGE] x": True, "[FIX] x": False, "x": False}


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("pos_*", ["pos_", "pos_a/b", "pos_\n"], ["pos", "xpos_"]),
        ("a?c", ["abc", "a.c"], ["ac", "abbc"]),
        ("[ab]x*", ["ax", "bxy"], ["cx"]),
        ("[!ab]x", ["cx"], ["ax"]),
        ("a.b", ["a.b"], ["axb"]),
        ("a[b", ["a[b"], ["ab"]),
        ("*z", ["z", "az"], ["za", "z\n"]),
    ],
)
def test_globs(spark, glob, yes, no):
    got = evaluate(spark, yes + no, matches_any(F.col("v"), (glob,)))
    assert got == {**dict.fromkeys(yes, True), **dict.fromkeys(no, False)}
    assert glob_to_regex(glob).startswith("(?s)^")


def test_extension_and_roots(spark):
    want = {"a/b.JS": "js", "a.d/b": "", "x.tar.gz": "gz", ".hidden": "hidden", "a/b.": ""}
    assert evaluate(spark, want, X.extension(F.col("v"))) == want
    got = evaluate(spark, ["core/a", "addons/b", "doc/c"], Rules(roots=("core/", "addons/")).in_roots(F.col("v")))
    assert got == {"core/a": True, "addons/b": True, "doc/c": False}


def test_identifiers(spark):
    want = {
        "_action_assign": True, "stock.move": True, "camelCase": True, " x_y ": True, "word": False, "two words_x": False,
        "": False, "ABC": False, "a-b_c": False, "x_y\n": True,
    }
    assert evaluate(spark, want, X.looks_like_identifier(F.col("v"))) == want


def test_text_helpers(spark):
    assert evaluate(spark, ["\x1c  a b　\n"], X.strip(F.col("v"))) == {"\x1c  a b　\n": "a b"}
    assert evaluate(spark, ["  \n "], X.snippet(F.col("v"))) == {"  \n ": None}
    import uuid

    ids = ["a", "ff" * 20, "é"]
    want = {i: str(uuid.uuid5(uuid.UUID(X.POINT_NAMESPACE), i)) for i in ids}
    assert evaluate(spark, ids, X.point_id(F.col("v"))) == want
    cut, flag = X.truncate_diff(F.col("v"), 3)
    assert evaluate(spark, ["abc", "abcd"], cut) == {"abc": "abc", "abcd": "abc\n... [truncated at 3 chars]"}
    assert evaluate(spark, ["abc", "abcd"], flag) == {"abc": False, "abcd": True}
    with pytest.raises(ValueError):
        X.truncate_diff(F.col("v"), -1)
    k = spark.createDataFrame([(0,), (7,), (99,)], "v int").select(X.clamp_k(F.col("v")))
    assert [r[0] for r in k.collect()] == [1, 7, 50]
    link = X.commit_link(F.lit("f0"), F.col("v"), {"b": "r/b"}, "r/a", "https://example.org")
    assert evaluate(spark, ["a", "b"], link) == {
        "a": "https://example.org/r/a/commit/f0",
        "b": "https://example.org/r/b/commit/f0",
    }
    day = spark.sql("SELECT TIMESTAMP '2024-03-01 10:00:00' AS t UNION ALL SELECT NULL").select(X.format_day(F.col("t")))
    assert sorted(r[0] for r in day.collect()) == ["2024-03-01", "?"]
