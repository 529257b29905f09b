"""Plans, results and metrics as text."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from tidemark.sources.modes import Scans


def plan(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as ``explain`` prints it."""
    jvm = df.sparkSession.sparkContext._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def _below(node) -> list:
    """A plan node's inputs, also through what adaptive execution wraps them in."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return [node.executedPlan()]
    if name.endswith("QueryStage"):
        return [node.plan()]
    return [node.children().apply(i) for i in range(node.children().size())]


def graph(df: DataFrame) -> str:
    """The physical plan's operators as a Graphviz digraph, from producers to consumers."""
    lines, todo = [], [(df._jdf.queryExecution().executedPlan(), None)]
    n = 0
    while todo:
        node, above = todo.pop()
        own, n = n, n + 1
        lines.append(f'  n{own} [label="{node.nodeName()}"];')
        if above is not None:
            lines.append(f"  n{own} -> n{above};")
        todo += [(x, own) for x in _below(node)]
    return "digraph plan {\n" + "\n".join(lines) + "\n}"


def metrics(df: DataFrame) -> dict[str, dict[str, int]]:
    """Runs df into the no-op sink; for each operator of the plan that ran the values of its metrics."""
    execution = df._jdf.queryExecution()
    began = time.perf_counter()
    rows = execution.toRdd().count()
    out = {"query": {"rows": rows, "ms": int(1000 * (time.perf_counter() - began))}}
    todo, k = [execution.executedPlan()], 0
    while todo:
        node = todo.pop()
        found, names = {}, node.metrics().keys().iterator()
        while names.hasNext():
            name = names.next()
            found[name] = node.metrics().apply(name).value()
        out[f"{k} {node.nodeName()}"] = found
        k += 1
        todo += _below(node)
    return out


def summary(df: DataFrame, scans: Scans | None = None) -> dict[str, float]:
    """Runs df as ``metrics`` does: bytes and rows read by scans, rows that came from memory,
    bytes shuffled, the share of the read rows that passed the filters right above, and with
    scans their cache's hits."""
    found = metrics(df)
    total = lambda kind, name: sum(m.get(name, 0) for k, m in found.items() if kind in k)
    read, kept = total("Scan parquet", "numOutputRows") + total("Scan csv", "numOutputRows"), total("InMemoryTableScan", "numOutputRows")
    filtered = total(" Filter", "numOutputRows")
    out = {
        **found["query"], "bytes_read": total("Scan parquet", "filesSize") + total("Scan csv", "filesSize"), "rows_read": read, "rows_from_memory": kept,
        "bytes_shuffled": total("Exchange", "shuffleBytesWritten"), "selectivity": filtered / (read + kept) if filtered and read + kept else 1.0,
    }
    return out | (scans.metrics() if scans else {})


def show(df: DataFrame, rows: int = 100) -> str:
    """The first rows as a text table, with types, and the seconds it took."""
    began = time.perf_counter()
    got = df.limit(rows).collect()
    cells = [df.columns, [t for _, t in df.dtypes], *([str(v) for v in r] for r in got)]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    rule = "+".join("-" * (w + 2) for w in width)
    body = ["| " + " | ".join(c.rjust(w) for c, w in zip(r, width)) for r in cells]
    return "\n".join([rule, *body[:2], rule, *body[2:], rule, f"{len(df.columns)} columns, {len(got)} rows, {time.perf_counter() - began:.2f} s"])
