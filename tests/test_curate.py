from pyspark.sql import functions as F

from patchlake.functions.rules import Rules
from patchlake.operators import curate as C
from patchlake.sources import changelog

RULES = Rules()


def block(path, body="+x\n", old=None):
    return f"diff --git a/{old or path} b/{path}\n@@\n{body}"


def parsed(spark, rows):
    """rows of (sha, subject, body, patch)."""
    df = spark.createDataFrame(rows, "sha string, subject string, body string, patch string")
    for name in ("author_name", "author_email"):
        df = df.withColumn(name, F.lit("x"))
    for name in ("authored_at", "committed_at"):
        df = df.withColumn(name, F.lit(None).cast("timestamp"))
    return df


def curated(spark, patch, rules=RULES, subject="[FIX] s"):
    rows = C.curate(parsed(spark, [("s", subject, "b", patch)]), rules, "community").collect()
    return rows[0].asDict() if rows else None


def test_excluded_only_commit_drops(spark):
    assert curated(spark, block("addons/l10n_fr/x.py") + block("addons/point_of_sale/y.py")) is None
    assert curated(spark, "") is None
    assert curated(spark, block("addons/sale/a.py"), subject="[MERGE] x") is None


def test_mixed_commit(spark):
    patch = block("addons/sale/a.py", "+keep\n") + block("addons/l10n_fr/b.py", "+drop\n") + block("addons/sale/i18n/de.po", "+po\n")
    row = curated(spark, patch)
    assert row["diff_text"] == block("addons/sale/a.py", "+keep\n")
    assert (row["modules"], row["files"], row["n_files"], row["tag"]) == (["sale"], ["addons/sale/a.py"], 1, "FIX")
    assert row["doc_text"] == "modules: sale\n[FIX] s\n\nb\n\n" + row["diff_text"].rstrip()


def test_order_and_duplicates(spark):
    row = curated(spark, block("addons/b/1.py") + block("addons/a/2.py") + block("addons/b/1.py"))
    assert row["files"] == ["addons/b/1.py", "addons/a/2.py", "addons/b/1.py"]
    assert row["modules"] == ["a", "b"] and row["n_files"] == 3


def test_caps_are_strict(spark):
    head = "diff --git a/addons/w/x.js b/addons/w/x.js\n"
    fits = head + "a" * (2000 - len(head))
    assert curated(spark, fits)["diff_text"] == fits
    long = curated(spark, fits + "é")["diff_text"]
    assert long == head + "[diff omitted: 2001 chars > 2000 (js asset)]\n"
    py = "diff --git a/addons/w/x.py b/addons/w/x.py\n"
    fits = py + "+" * (24000 - len(py))
    assert curated(spark, fits)["diff_text"] == fits
    row = curated(spark, fits + "\n" + block("addons/v/z.py"))
    assert row["diff_text"] == fits + "\n[commit diff truncated at 24000 chars]\n"
    assert row["n_files"] == 2


def test_block_splitting(spark):
    patch = (
        "preamble diff --git a/no b/no\n"
        + block("addons/a/deleted.py", old="addons/a/deleted.py").replace(" b/addons/a/deleted.py", " b/dev/null")
        + block("addons/a/new.py", old="addons/a/old.py")
        + block("addons/a/with blank.py")
        + 'diff --git "a/addons/q\\303.py" "b/addons/q\\303.py"\n@@\n'
        + block("addons/a/u.py", "+one diff --git a/x b/x\n+ diff --git a/y b/y\n")
    )
    df = parsed(spark, [("s", "x", "", patch)])
    rows = C.explode_blocks(df, RULES).orderBy("pos").collect()
    assert [r.path for r in rows] == ["addons/a/deleted.py", "addons/a/new.py", "addons/a/with", "addons/a/u.py"]
    assert rows[3].block.endswith("+ diff --git a/y b/y\n")
    assert df.select(C.n_unparsed_blocks(F.col("patch"))).first()[0] == 1


def test_installed_row_form_equals_rules(spark):
    patch = block("addons/sale/a.py") + block("addons/stock/b.py") + block("core/c.py") + block("addons/payment_paypal/d.py")
    blocks = C.explode_blocks(parsed(spark, [("s", "x", "", patch)]), RULES)
    installed = spark.createDataFrame([("sale",)], "module string")
    kept = {r.module for r in C.keep_installed(blocks, installed, RULES).collect()}
    row = curated(spark, patch, RULES.only_installed(["sale"]))
    assert kept == set(row["modules"]) == {"sale", "core", "payment_paypal"}


def test_source_label(spark):
    df = parsed(spark, [("s", "x", "", block("addons/a/x.py"))])
    assert C.curate(df, RULES).first().source == "community"
    assert C.curate(df, RULES, "enterprise").first().source == "enterprise"


def test_log_records(spark, tmp_path):
    def record(*fields, patch="p"):
        return "\x1f".join(fields) + "\x1d" + patch

    good = ["s1", "n", "e", "2024-01-02T03:04:05+02:00", "", "subj", "line1\nline2"]
    log = "\x1e".join(
        [
            "",
            record(*good, patch="a\r\nb\rc\n"),
            "  \n",
            record("s2", "n", "e", "t", "t", "six fields"),
            record("s3", "n", "e", "not a time", "", "subj", "body", "extra", patch="x\x1dy"),
            "\x1f".join(["s4", *good[1:]]),
        ]
    ).encode() + b"\x1es5\x1fn\xff\x1fe\x1f\x1f\x1fs\x1fb\x1dp\xe2\x28"
    (tmp_path / "log").write_bytes(log)
    rows = {r.sha: r for r in changelog.parse_records(changelog.read_log(spark, str(tmp_path / "log"))).collect()}
    assert set(rows) == {"s1", "s3", "s4", "s5"}
    assert rows["s1"].patch == "a\nb\nc\n" and rows["s1"].body == "line1\nline2"
    assert rows["s1"].authored_at.isoformat() == "2024-01-02T01:04:05" and rows["s1"].committed_at is None
    assert rows["s3"].authored_at is None and rows["s3"].patch == "x\x1dy" and rows["s3"].body == "body"
    assert rows["s4"].patch == ""
    assert rows["s5"].author_name == "n�" and rows["s5"].patch == "p�("


def test_range_and_merges(spark):
    end = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "sha string, n_parents int")
    start = spark.createDataFrame([("c",)], "sha string")
    assert [r.sha for r in changelog.drop_merges(changelog.in_range(end, start)).collect()] == ["a"]
