"""Sinks: result tables, sorted name and exclusion lists, small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def write_name_list(regions: DataFrame, path: str) -> None:
    """`start-end module` lines in order of start; a range-partitioned sort, so file order is line order."""
    line = F.format_string("%06x-%06x %s", "start", "end", "module")
    regions.orderBy("start", "end", "module").select(line.alias("value")).write.mode("overwrite").text(path)


def report(title: str, sections: dict[str, DataFrame], rows: int = 40) -> str:
    """A Markdown report; each section shows its first `rows` rows and says how many there are."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        shown = df.limit(rows).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in shown]
        out += ["", f"{df.count()} rows", ""]
    return "\n".join(out)
