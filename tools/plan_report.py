"""Write PLANS.md: the physical operator trees (explain "simple", initial
adaptive plan) of selected headline queries, for plan review."""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NOTES = {
    "pa_base100": "lineitem is partially aggregated per order before the join (map-side combine), "
                  "the per-order side is joined to orders on the key, the priority x month "
                  "aggregate is partial+final, and one exchange on the series keys serves the windows.",
    "corr_lags": "one exchange on the entity key feeds the change/lag windows; all pairs and all "
                 "11 lags are expressions of one partial+final aggregate, then `inline` (Generate).",
    "event_study": "the three phase rows per distinct interval are joined to the panel on the period "
                   "and pivoted; the events are left-joined to the result on their interval.",
}


def tree(df) -> str:
    jvm = df.sparkSession._jvm
    s = jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(),
                                                                         "simple")
    body = s.split("== Physical Plan ==")[-1]
    out = []
    for line in body.strip().splitlines():
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        out.append(line[:180])
    return "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from cadence.session import get_spark
    from cadence.plans.bench_queries import headline
    spark = get_spark("plans", 8)
    qs = headline()
    lines = ["# PLANS — physical plans of selected headline queries", "",
             f"Generated by `tools/plan_report.py` at `{sf}` (explain `simple`, initial adaptive",
             "plan; AQE may still switch joins to broadcast and coalesce partitions at run time).", ""]
    for name in NOTES:
        lines += [f"## {name}", "", NOTES[name], "", "```", tree(qs[name](spark, sf)), "```", ""]
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    open(os.path.join(root, "PLANS.md"), "w").write("\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main()
