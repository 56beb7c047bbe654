"""What leaves the engine: result rows, backfilled tables, feedback, reports, playbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.evaluation import bottom, grade, strata, summary, tag_frequency

#: What codes of judgements are called: fixed values.
LABELS = {"accurate": "召回准确", "inaccurate": "召回不准确", "correct": "引用正确", "incorrect": "引用错误", "not_applicable": "不适用"}


def backfilled(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions (row_index, question, answer) with the answers of the rows that succeeded."""
    good = answers.where("status = 'succeeded'").select("row_index", F.col("answer").alias("new"))
    return questions.join(good, "row_index", "left").withColumn("answer", F.coalesce("new", "answer")).drop("new")


def result_rows(results: DataFrame) -> DataFrame:
    """Results as rows of a sheet: failures have no total but a reason."""
    failed = F.col("status") != "scored"
    return results.select("item_id", F.when(failed, "").otherwise(F.coalesce("answer", F.lit(""))).alias("answer"), F.when(failed, F.lit(None)).otherwise(F.col("total_score")).alias("total"), F.coalesce(grade(F.when(~failed, F.col("total_score"))), F.lit("")).alias("grade"), F.array_join("error_tags", "；").alias("tags"), "status")


def bad_cases(rows: DataFrame) -> DataFrame:
    """The rows that were judged not usable, without that column."""
    return rows.where(~F.coalesce("usable", F.lit(False))).drop("usable")


def labelled(rows: DataFrame, columns: list[str], labels: dict[str, str] = LABELS) -> DataFrame:
    """rows with a label column beside each code column; an unknown code is its own label."""
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return rows.withColumns({f"{c}_label": F.coalesce(F.try_element_at(table, F.col(c)), F.col(c)) for c in columns})


def playbook(items: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, markdown) of items (case, section_no, section, pos, title, lines array<string>)."""
    body = lambda x: F.concat(F.lit("### "), x["title"], F.lit("\n"), F.array_join(F.transform(x["lines"], lambda v: F.concat(F.lit("- "), v)), "\n"))
    part = items.groupBy(case, "section_no", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "lines"))).alias("parts"))
    part = part.withColumn("md", F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.array_join(F.transform("parts", body), "\n\n")))
    whole = part.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("section_no", "md"))).alias("s"))
    return whole.select(case, F.concat(F.lit("# "), F.col(case).cast("string"), F.lit("\n\n"), F.array_join(F.transform("s", lambda x: x["md"]), "\n\n")).alias("markdown"))


def report(results: DataFrame, statuses: DataFrame) -> str:
    """A short Markdown report; it holds a few aggregated rows only."""
    s = summary(results).head().asDict()
    out = ["# Evaluation", "", *(f"- {k}: {v}" for k, v in s.items()), "", "| stratum | items | mean | passed |", "| --- | --- | --- | --- |"]
    out += [f"| {r.stratum} | {r.n_items} | {r.mean_score} | {r.pass_rate} |" for r in strata(results, statuses).orderBy("stratum").collect()]
    out += ["", "| tag | n |", "| --- | --- |", *(f"| {r.tag} | {r.n} |" for r in tag_frequency(results).orderBy(F.desc("n"), "tag").limit(20).collect())]
    return "\n".join([*out, "", "Lowest: " + ", ".join(str(r.item_id) for r in bottom(results).collect())])
