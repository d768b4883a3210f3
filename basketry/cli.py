"""Command line over files: ``python -m basketry.cli COMMAND FILE ...``; run it with spark-submit on a cluster."""

from __future__ import annotations

import argparse
import re
import sys
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import membership as M
from .operators import action, classify, fuzzy, gradual, itemsets, quantitative, rules, sequences, significance, taxonomy, temporal
from .session import cut
from .sources import datasets, sinks
from .sources import transactions as read


def _share(text: str) -> float:
    value = float(text)
    if not 0 < value <= 1:
        raise argparse.ArgumentTypeError("must lie in (0, 1]")
    return value


def window_size(text: str) -> int | timedelta:
    """Rows, or a duration like 7D, 12h, 30min."""
    if text.isdecimal():
        return int(text)
    m = re.fullmatch(r"(\d+)\s*(D|h|min|s)", text)
    if not m:
        raise argparse.ArgumentTypeError("rows, or a duration like 7D, 12h, 30min")
    return timedelta(seconds=int(m[1]) * {"D": 86400, "h": 3600, "min": 60, "s": 1}[m[2]])


def train_rows(rows: DataFrame, fraction: float) -> tuple[DataFrame, DataFrame]:
    """The first share of the rows and the rest; both must have two rows at least."""
    n = rows.count()
    at = int(n * fraction)
    if not 0 < fraction < 1 or at < 2 or n - at < 2:
        raise ValueError(f"--train-fraction must lie in (0, 1) and leave two rows on each side of {n}")
    return rows.where(F.col("pos") < at), rows.where(F.col("pos") >= at)


def _baskets(spark, a):
    return cut(read.read_baskets(spark, a.file, a.sep))


def _significant(found: DataFrame, n: int, a, family: int | None = None) -> DataFrame:
    if a.alpha is None:
        return found
    return significance.significant_rules(found, n, a.alpha, a.correction, a.test, n_tests=family)


def _sensor_rows(spark, a) -> DataFrame:
    return cut(read.read_sensors(spark, a.file, a.time, n_symbols=a.symbols, calendar=a.calendar or ()))


def run_rules(spark, a):
    b = _baskets(spark, a)
    found = cut(itemsets.frequent_itemsets(b, a.min_supp, a.max_len or None))
    out = _significant(rules.association_rules(found, a.metric, a.min_threshold), b.count(), a, rules.candidate_rule_count(found))
    return rules.prune_redundant_rules(cut(out)) if a.prune else out


def run_generalized(spark, a):
    return taxonomy.generalized_rules(_baskets(spark, a), taxonomy.Taxonomy(read.read_pairs(spark, a.taxonomy)), a.min_supp, a.metric, a.min_threshold, a.max_len or None, a.interest)


def run_quantitative(spark, a):
    table = spark.read.csv(a.file, header=True, inferSchema=True).withColumn("_tid", F.monotonically_increasing_id())
    return quantitative.quantitative_rules(table, "_tid", a.min_supp, a.intervals, a.max_supp, metric=a.metric, min_threshold=a.min_threshold, interest=a.interest, max_len=a.max_len or None)


def run_top_k(spark, a):
    return rules.top_k_rules(_baskets(spark, a), a.k, a.min_conf, max_len=a.max_len or None)


def run_rare(spark, a):
    return rules.rare_rules(_baskets(spark, a), a.max_supp, least=a.min_count, min_conf=a.min_conf)


def run_utility(spark, a):
    q = spark.read.csv(a.file, header=True, schema="tid string, item string, qty double")
    return rules.high_utility_rules(itemsets.utility_table(q, read.read_profits(spark, a.profits) if a.profits else None), a.min_utility, min_conf=a.min_conf)


def _memberships(frame: DataFrame, a, skip=()) -> tuple[DataFrame, list[str]]:
    numeric = [f.name for f in frame.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    table = M.auto_fuzzify(frame, numeric, a.labels, a.method, a.membership)
    return table, [c for c in table.columns if c not in frame.columns]


def run_fuzzy(spark, a):
    table, names = _memberships(spark.read.csv(a.file, header=True, inferSchema=True), a)
    rows = cut(table.select(M.fuzzy_transactions(table, names).alias("s")).select(F.col("s.item").alias("items"), F.col("s.degree").alias("degrees")))
    return rules.fuzzy_association_rules(fuzzy.fuzzy_itemsets(rows, a.min_supp, a.alpha_cuts, max_len=a.max_len or None), "FConf", a.min_threshold)


def run_gradual(spark, a):
    return gradual.gradual_rules(spark.read.csv(a.file, header=True, inferSchema=True), a.min_supp, a.min_threshold, max_rows=a.max_rows)


def run_temporal(spark, a):
    rows = _sensor_rows(spark, a)
    return _significant(temporal.temporal_association_rules(rows, a.max_lag, a.min_supp, a.metric, a.min_threshold, targets=a.target), rows.count() - a.max_lag, a)


def run_drift(spark, a):
    rows = _sensor_rows(spark, a)
    found, n = temporal.window_rules(rows, a.window, a.step, a.min_supp, a.metric, a.min_threshold)
    return temporal.rule_drift(cut(found), n, stable_fraction=a.stable_fraction)


def run_sequences(spark, a):
    return sequences.prefixspan(read.read_sequences(spark, a.file), a.min_supp, a.max_len or None).withColumn("sequence", sequences.format_sequence(F.col("sequence")))


def run_sequential(spark, a):
    s = read.read_sequences(spark, a.file)
    conf = a.min_threshold if a.metric == "confidence" else 0.0
    if a.veto:
        return sequences.sequential_veto_rules(s, a.min_supp, a.min_threshold, a.max_antecedent)
    return sequences.sequential_rules(s, a.min_supp, conf, a.max_antecedent, a.max_consequent, a.metric, a.min_threshold)


def _fuzzy_sequences(spark, a):
    table, names = _memberships(spark.read.csv(a.file, header=True, inferSchema=True), a, (a.sequence, a.time))
    return sequences.fuzzy_sequences_from_memberships(table, names, a.time, a.sequence)


def run_fuzzy_sequences(spark, a):
    return sequences.fuzzy_prefixspan(_fuzzy_sequences(spark, a), a.min_supp, a.max_len or 4, tnorm=a.tnorm).withColumn("sequence", sequences.format_sequence(F.col("sequence")))


def run_fuzzy_sequential(spark, a):
    conf = a.min_threshold if a.metric == "confidence" else 0.0
    return sequences.fuzzy_sequential_rules(_fuzzy_sequences(spark, a), a.min_supp, conf, a.max_antecedent, a.max_consequent, a.metric, a.min_threshold, a.tnorm)


def _normal(train: DataFrame, a) -> DataFrame:
    """Rules of the training rows; antecedents lie in the past, or in the same row if there is no lag."""
    if a.max_lag > 0:
        found = temporal.temporal_association_rules(train, a.max_lag, a.min_supp, "confidence", a.min_threshold, same_time_antecedent=False, exclude_persistence=a.exclude_persistence)
    else:
        found = rules.association_rules(itemsets.frequent_itemsets(train, a.min_supp), "confidence", a.min_threshold)
    found = _significant(found, max(train.count() - a.max_lag, 1), a)
    if a.single_consequent:
        found = found.where(F.size("consequents") == 1)
    found = cut(found)
    return found if a.min_improvement is None else cut(rules.prune_unproductive_rules(found, a.min_improvement))


def run_anomalies(spark, a):
    rows = _sensor_rows(spark, a)
    train, test = train_rows(rows, a.train_fraction)
    found = action.detect_anomalies(rows, _normal(train, a), a.min_score, None, a.weight)
    return found.join(test.select("pos", "ts"), "pos")


def run_forecast(spark, a):
    rows = _sensor_rows(spark, a)
    train, test = train_rows(rows, a.train_fraction)
    found = _normal(train, a)
    return action.evaluate_forecast(test, found, a.threshold) if a.evaluate else action.forecast_next(rows, found)


def run_next_events(spark, a):
    s = cut(read.read_sequences(spark, a.file))
    test = F.pmod(F.xxhash64("sid"), F.lit(1000)) < int(1000 * a.test_fraction)
    if a.history:
        found = cut(sequences.sequential_rules(s.where(~test), a.min_supp, a.min_threshold, a.max_antecedent, a.max_consequent))
        history = spark.createDataFrame([(0, [e.split(",") for e in a.history.split(";")])], "sid int, elements array<array<string>>")
        return action.predict_next_events(history, found)
    if not a.test_fraction:
        raise ValueError("next-events needs --history or --test-fraction")
    train = s.where(~test)
    found = cut(sequences.sequential_rules(train, a.min_supp, a.min_threshold, a.max_antecedent, a.max_consequent))
    return action.evaluate_next_events(s.where(test), found, a.k, train=train)


def run_classify(spark, a):
    table = spark.read.csv(a.file, header=True, inferSchema=True).withColumn("_tid", F.monotonically_increasing_id())
    partition = quantitative.IntervalPartition(a.intervals, columns=[c for c in table.columns if c not in ("_tid", a.label)]).fit(table)
    cases = cut(partition.transform(table, "_tid").join(table.select(F.col("_tid").alias("tid"), F.col(a.label).cast("string").alias("label")), "tid"))
    test = F.pmod(F.xxhash64("tid", F.lit(a.seed)), F.lit(1000)) < int(1000 * a.test_fraction)
    model = classify.RuleClassifier(a.min_supp, a.min_threshold, a.max_len or 3).fit(cases.where(~test), "label")
    print(f"accuracy {model.score(cases.where(test), 'tid', 'label')}", file=sys.stderr)
    return model.rules_


def run_generate(spark, a):
    if a.kind == "sequences":
        made = datasets.make_sequences(spark, a.n, a.items, a.length, a.seed)
        return made.select(F.array_join(F.transform("elements", lambda e: F.array_join(e, ",")), ";").alias("value"))
    return datasets.make_transactions(spark, a.n, a.items, a.length, a.seed).select(F.array_join("items", ",").alias("value"))


COMMANDS = {
    "rules": run_rules, "generalized-rules": run_generalized, "quantitative-rules": run_quantitative, "top-k-rules": run_top_k, "rare-rules": run_rare,
    "high-utility-rules": run_utility, "fuzzy-rules": run_fuzzy, "gradual-rules": run_gradual, "temporal-rules": run_temporal, "rule-drift": run_drift,
    "sequences": run_sequences, "sequential-rules": run_sequential, "fuzzy-sequences": run_fuzzy_sequences, "fuzzy-sequential-rules": run_fuzzy_sequential,
    "anomalies": run_anomalies, "forecast": run_forecast, "next-events": run_next_events, "classify": run_classify, "generate": run_generate,
}


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="basketry", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        add = p.add_argument
        if name != "generate":
            add("file")
        add("--format", choices=["table", "csv", "json", "parquet"], default="table")
        add("-o", "--output")
        add("--sort-by")
        add("--top", type=int)
        add("--sep", default=",")
        classes = name == "classify"
        add("--min-supp", type=_share, default=0.05 if classes else 0.1)
        add("--min-threshold", type=float, default={"quantitative-rules": 0.8, "anomalies": 0.9, "forecast": 0.8, "rule-drift": 0.8, "next-events": 0.3, "classify": 0.6}.get(name, 0.7))
        add("--metric", default="confidence")
        add("--max-len", type=int, default={"top-k-rules": 6, "classify": 3}.get(name, 0))
        add("--alpha", type=float)
        add("--correction", default="fdr_bh", choices=["bonferroni", "holm", "fdr_bh", "fdr_by"])
        add("--test", default="fisher", choices=["fisher", "chi2"])
        add("--prune", action="store_true")
        add("--seed", type=int, default=0)
        if name in ("generalized-rules", "quantitative-rules"):
            add("--interest", type=float)
        if name == "generalized-rules":
            add("--taxonomy", required=True)
        if name in ("quantitative-rules", "classify"):
            add("--intervals", type=int, default=8 if not classes else 4)
        if name == "quantitative-rules":
            add("--max-supp", type=_share, default=0.5)
        if name in ("top-k-rules", "rare-rules", "high-utility-rules"):
            add("--min-conf", type=float, default=0.6)
        if name == "top-k-rules":
            add("-k", type=int, required=True)
        if name == "rare-rules":
            add("--max-supp", type=_share, required=True)
            add("--min-count", type=int, default=2)
        if name == "high-utility-rules":
            add("--profits")
            add("--min-utility", type=float, default=0.1)
        if name in ("fuzzy-rules", "fuzzy-sequences", "fuzzy-sequential-rules"):
            add("--labels", type=int, default=3)
            add("--method", default="quantile", choices=["uniform", "quantile", "kmeans"])
            add("--membership", default="triangular", choices=list(M.PARTITIONS))
            add("--tnorm", default="min", choices=["min", "product"])
            add("--alpha-cuts", type=int, default=10)
        if name in ("fuzzy-sequences", "fuzzy-sequential-rules"):
            add("--sequence", required=True)
        if name in ("temporal-rules", "rule-drift", "anomalies", "forecast", "fuzzy-sequences", "fuzzy-sequential-rules"):
            add("--time", default="time")
            add("--symbols", type=int, default=3)
            add("--calendar", nargs="*")
            add("--max-lag", type=int, default=1)
        if name == "temporal-rules":
            add("--target", nargs="*")
        if name == "gradual-rules":
            add("--max-rows", type=int)
        if name == "rule-drift":
            add("--window", type=window_size, required=True)
            add("--step", type=window_size)
            add("--stable-fraction", type=float, default=0.8)
        if name in ("sequential-rules", "fuzzy-sequential-rules", "next-events"):
            add("--max-antecedent", type=int, default=2)
            add("--max-consequent", type=int, default=1 if name == "next-events" else 2)
        if name == "sequential-rules":
            add("--veto", action="store_true")
        if name in ("anomalies", "forecast"):
            add("--exclude-persistence", action="store_true")
            add("--single-consequent", action="store_true")
            add("--min-improvement", type=float)
            add("--train-fraction", type=float, default=0.5)
        if name == "anomalies":
            add("--min-score", type=float, default=0.0)
            add("--weight", default="surprise", choices=["surprise", "confidence", "count"])
        if name == "forecast":
            add("--threshold", type=float, default=0.5)
            add("--evaluate", action="store_true")
        if name == "next-events":
            add("--history")
            add("--test-fraction", type=float, default=0.0)
            add("-k", type=int, default=1)
        if classes:
            add("--label", required=True)
            add("--test-fraction", type=float, default=0.3)
        if name == "generate":
            add("--kind", default="transactions", choices=["transactions", "sequences"])
            add("-n", type=int, default=1000)
            add("--items", type=int, default=100)
            add("--length", type=int, default=8)
        p.set_defaults(run=COMMANDS[name])
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    try:
        spark = spark or SparkSession.builder.appName("basketry").getOrCreate()
        out = args.run(spark, args)
        if args.command == "generate" and args.output:
            out.write.mode("overwrite").text(args.output)
            return 0
        text = sinks.emit(out, args.sort_by, args.top, args.format, args.output)
        if text is not None:
            print(text)
        return 0
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
