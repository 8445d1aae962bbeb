"""Probes from templates: sentences, code, markup and addresses by category, cut at drawn ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import probes, ranking

# Shares of the categories, ratios of the cut, language of a category.
WEIGHTS = {
    "chinese_natural": 0.15, "english_natural": 0.15, "code": 0.15, "chinese_english_mixed": 0.10, "number_date_amount": 0.10,
    "json_yaml_markdown": 0.10, "url_path_email": 0.10, "truncated_partial": 0.15,
}
RATIOS = (0.3, 0.5, 0.7, 0.9)
LANGUAGE = {"chinese_natural": "chinese", "english_natural": "english", "code": "code"}
#: The category whose templates end inside a word already.
PARTIAL = "truncated_partial"

TEMPLATES = {
    "chinese_natural": ("清晨的市场里，摊主们正在整理刚到的蔬菜和水果。", "图书馆三楼的窗边总是坐满了准备考试的学生。", "这场雨下了整整两天，河水已经漫过了石桥。", "他把旧相册放回抽屉，轻轻关上了灯。"),
    "english_natural": ("The ferry left the harbour just before the fog came in.", "Nobody at the table wanted to be the first to speak.", "A careful reader will notice the second footnote.", "Rain had washed the chalk marks off the pavement by noon."),
    "code": ("for row in reader:\n    total += float(row['amount'])", "const sum = items.reduce((a, b) => a + b.price, 0);", "if err != nil {\n\treturn fmt.Errorf(\"open: %w\", err)\n}", "SELECT name, COUNT(*) FROM visits GROUP BY name HAVING COUNT(*) > 3;"),
    "chinese_english_mixed": ("请先运行 make install，然后检查 config 目录。", "这个 API 返回的 status code 是 404 而不是 200。", "会议改到 Friday 下午，地点还是 Room B。", "把 branch 合并到 main 之前记得跑 unit test。"),
    "number_date_amount": ("Invoice 20931 of 2024-03-17 comes to 1,284.50 EUR.", "Call between 09:30 and 17:45 on 12/08/2025.", "3.14159 rounds to 3.14, and 2.71828 to 2.72.", "总计 ¥12,800.00，税率 6%，日期 2023年11月5日。"),
    "json_yaml_markdown": ('{"id": 17, "tags": ["red", "round"], "size": {"w": 4, "h": 9}}', "services:\n  web:\n    image: nginx\n    ports:\n      - 8080:80", "## Results\n\n| run | score |\n| --- | --- |\n| 1 | 0.83 |", "- [ ] write the tests\n- [x] read the notes"),
    "url_path_email": ("https://example.org/articles/2024/05?page=3&sort=date", "/var/lib/service/cache/index-0042.bin", "Write to support.team@example.net before Monday.", "C:\\\\Users\\\\guest\\\\Documents\\\\report_final.docx"),
    "truncated_partial": ("The committee postponed its deci", "import numpy as n", "他们决定明天一早出", "https://example.com/downl", '{"status": "succ', "git commit -m \"fix typ"),
}


def generate(spark: SparkSession, total: int = 500, weights: dict[str, float] | None = None, ratios: tuple[float, ...] = RATIOS, seed: int = 42) -> DataFrame:
    """(probe_id, text, category, truncation_ratio, source_lang), in a drawn order: categories by their weights, each text drawn
    from its category's templates and cut at a drawn ratio; ids tell repeats apart."""
    quota = [(k, n) for k, n in probes.allocate(total, weights or WEIGHTS).items() if TEMPLATES.get(k)]
    unknown = set(weights or ()) - set(TEMPLATES)
    if unknown:
        raise ValueError("unknown categories: " + ", ".join(sorted(unknown)))
    rows = spark.createDataFrame(quota, "category string, n int").select("category", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    texts = F.create_map(*(x for k, v in TEMPLATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.col("category")]
    nth = lambda what, values: F.get(values, ranking.draw(ranking.digest("category", F.col("i").cast("string"), F.lit(what), seed), F.size(values)).cast("int"))
    ratio = F.when(F.col("category") == PARTIAL, 0.0).otherwise(nth("ratio", F.array(*map(F.lit, ratios))))
    rows = rows.withColumns({"whole": nth("text", texts), "truncation_ratio": ratio})
    rows = rows.withColumn("text", F.when(F.col("category") == PARTIAL, F.col("whole")).otherwise(T.truncate(F.col("whole"), F.col("truncation_ratio"))))
    language = F.coalesce(F.create_map(*(F.lit(x) for kv in LANGUAGE.items() for x in kv))[F.col("category")], F.lit("mixed"))
    id_ = F.concat("category", F.lit("_"), F.substring(ranking.digest("category", F.col("i").cast("string"), seed), 1, 12))
    return rows.select(id_.alias("probe_id"), "text", "category", "truncation_ratio", language.alias("source_lang")).orderBy(ranking.digest("probe_id", seed))
