"""Record text parsers (JSON object text, ``key: value`` lines) as column expressions,
plus the KV and GEN test views.

Parsing is per row (no shuffle): a record text becomes an ordered array of
``struct<k, v>`` entries; duplicate keys keep the last value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .fixtures import exam, read_table

KEY_FULL = r"^(.*?)："
VAL_FULL = r"^.*?：(.*)$"
KEY_HALF = r"^(.*?):"
VAL_HALF = r"^.*?:(.*)$"


#: line ends that a text may hold inside a line: there "." and "$" of the patterns stop
INNER_LINE_ENDS = ("\u0085", "\u2028", "\u2029")


def kv_entries(text: Column) -> Column:
    """'key: value' / '键：值' lines -> array<struct<k,v>>; full-width colon wins, split once,
    lines without a colon or with an empty key are skipped, last key wins."""
    text = F.coalesce(text, F.lit(""))

    def cut(s: Column, colon: str) -> Column:
        key = F.substring_index(s, colon, 1)
        return F.struct(F.trim(key).alias("k"), F.trim(s.substr(F.length(key) + 2, F.length(s))).alias("v"))

    def matched(s: Column, key: str, value: str) -> Column:
        return F.struct(F.trim(F.regexp_extract(s, key, 1)).alias("k"), F.trim(F.regexp_extract(s, value, 1)).alias("v"))

    def parsed(full: Callable[[Column], Column], half: Callable[[Column], Column]) -> Column:
        lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda s: F.trim(s))
        entries = F.transform(lines, lambda s: F.when(s.contains("："), full(s)).when(s.contains(":"), half(s)))
        return F.filter(entries, lambda e: e.isNotNull() & (e["k"] != ""))

    odd = text.contains(INNER_LINE_ENDS[0]) | text.contains(INNER_LINE_ENDS[1]) | text.contains(INNER_LINE_ENDS[2])
    entries = F.when(odd, parsed(lambda s: matched(s, KEY_FULL, VAL_FULL), lambda s: matched(s, KEY_HALF, VAL_HALF))) \
        .otherwise(parsed(lambda s: cut(s, "："), lambda s: cut(s, ":")))

    def last(all_entries: Column) -> Column:
        return F.filter(all_entries, lambda e, i: ~F.exists(F.slice(all_entries, i + 2, F.size(all_entries) + 1),
                                                            lambda x: x["k"] == e["k"]))

    # as a lambda's argument the parsed lines are evaluated once a text, not once for each of their entries
    return F.element_at(F.transform(F.array(entries), last), 1)


def entries_text(entries: Column) -> Column:
    """Canonical text of a parsed record: 'k=v' sorted by key, ';'-joined."""
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["k"], F.lit("="), e["v"])), ";")


def json_entries(text: Column) -> Column:
    """JSON object text -> array<struct<k,v>> (values as text); not an object -> empty."""
    m = F.from_json(text, "map<string,string>")
    arr = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return F.when(F.trim(text).startswith("{") & m.isNotNull(), arr).otherwise(F.array().cast("array<struct<k:string,v:string>>"))


def record_entries(text: Column) -> Column:
    """Dispatch: JSON object text when it starts with '{', else key/value lines."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t.startswith("{"), json_entries(t)).otherwise(kv_entries(t))


# ------------------------------------------------------------------ views

def kv(spark: SparkSession, sf: str) -> DataFrame:
    """KV: four EXAM fields as key/value lines with blank, colon-less, duplicate and empty-key lines."""
    e = exam(spark, sf)
    text = F.concat_ws("\n",
                       F.concat(F.lit("job: "), F.coalesce("job", F.lit(""))), F.lit(""),
                       F.concat(F.lit("年龄："), F.col("age").cast("string")),
                       F.lit("free text without a colon"),
                       F.concat(F.lit("  sbp_result : "), F.coalesce("sbp_result", F.lit(""))),
                       F.concat(F.lit("job："), F.col("gender")),
                       F.lit(":orphan value"),
                       F.concat(F.lit("exposure: "), F.coalesce("exposure", F.lit(""))),
                       F.lit("mixed: a：b"))
    return e.select("record_id", "label", "exposure", text.alias("kv_text"))


GEN_HEADINGS = "\n一、岗位处置建议：保持观察。\n二、复查/转诊建议：按期复查。"
GEN_BAD = "\n请提供更多信息"


def gen(spark: SparkSession, sf: str) -> DataFrame:
    """GEN: assistant turns as generated advice; headings for conv_id % 3 = 0, a bad marker for conv_id % 7 = 0."""
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text").where(F.col("role") == "assistant")
    text = F.concat(F.col("text"), F.when(F.col("conv_id") % 3 == 0, F.lit(GEN_HEADINGS)).otherwise(F.lit("")),
                    F.when(F.col("conv_id") % 7 == 0, F.lit(GEN_BAD)).otherwise(F.lit("")))
    return c.select("conv_id", "turn", text.alias("text"))


REJECT_DATASET = "请选择有效的数据集样本。"
REJECT_UPLOAD = "上传文件为空或格式无法识别。"
REJECT_MANUAL = "手动录入内容为空或格式无法识别。"
MODES = ["dataset", "manual", "upload"]
_ = C  # fixed values above are the original's user-facing messages
