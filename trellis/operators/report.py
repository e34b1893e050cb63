"""Reports and exports: small aggregates are formatted on the driver, everything before is distributed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.operators import graph

CHARS_EACH, CHARS_ALL = 500, 12_000
REPORT = "community_id string, title string, summary string, rating int, findings array<string>, cited array<string>, members int"


def graph_report(nodes: DataFrame, edges: DataFrame) -> str:
    """Markdown: counts, hubs, communities by size, strongest edges between communities."""
    hubs = graph.degree(edges).orderBy(F.desc("degree"), "id").limit(10).collect()
    sizes = graph.community_stats(nodes, edges).orderBy(F.desc("members"), "community_id").limit(20).collect()
    cross = graph.cross_community(nodes, edges).collect()
    out = ["# Graph report", "", f"Nodes: {nodes.count()}", f"Edges: {edges.count()}", "", "## Hubs", ""]
    out += [f"- {r['id']} ({r['degree']})" for r in hubs]
    out += ["", "## Communities", "", *[f"- {r['community_id']}: {r['members']} members, density {r['density']}" for r in sizes]]
    out += ["", "## Edges between communities", "", *[f"- {r['src']} -> {r['dst']} ({r['relation']}, {r['score']})" for r in cross]]
    return "\n".join(out) + "\n"


def community_prompts(nodes: DataFrame, least: int = 3, chars: int = CHARS_ALL) -> DataFrame:
    """(community_id, members, prompt): the members' texts, 500 characters of each, as many as fit into a budget.

    What is over the budget is cut before the texts are gathered, so a group's text is bounded
    by the budget, not by the size of the community.
    """
    line = F.concat(F.lit("- "), F.col("id"), F.lit(": "), F.substring(F.coalesce("content", F.lit("")), 1, CHARS_EACH))
    rows = nodes.filter(F.col("community_id").isNotNull()).select("community_id", "id", line.alias("line"))
    w = Window.partitionBy("community_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    fit = rows.withColumn("used", F.sum(F.length("line")).over(w)).filter(F.col("used") <= chars)
    size = rows.groupBy("community_id").agg(F.count("*").cast("int").alias("members")).filter(F.col("members") >= least)
    text = fit.groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("l"), F.count("*").alias("n"))
    more = F.when(F.col("members") > F.col("n"), F.concat(F.lit("\n… "), (F.col("members") - F.col("n")).cast("string"), F.lit(" more"))).otherwise("")
    return size.join(text, "community_id").select("community_id", "members", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), more).alias("prompt"))


def first_json(text: str) -> dict | None:
    """The first balanced JSON object in an answer; null if there is none."""
    start = text.find("{")
    while start >= 0:
        try:
            got, _ = json.JSONDecoder().raw_decode(text[start:])
            return got if isinstance(got, dict) else None
        except ValueError:
            start = text.find("{", start + 1)
    return None


def community_reports(nodes: DataFrame, ask: Callable[[str], str], least: int = 3) -> DataFrame:
    """A report per community from an injected function; an answer that cannot be read gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for cid, members, prompt in zip(pdf["community_id"], pdf["members"], pdf["prompt"]):
                got = first_json(ask(prompt) or "")
                if got is not None:
                    rating = got.get("rating")
                    rows.append((cid, str(got.get("title") or cid), str(got.get("summary") or ""), rating if isinstance(rating, int) else 5, [str(x) for x in got.get("key_findings") or []], [str(x) for x in got.get("cited_nodes") or []], members))
            yield pd.DataFrame(rows, columns=["community_id", "title", "summary", "rating", "findings", "cited", "members"])

    return community_prompts(nodes, least).mapInPandas(run, REPORT)


def save_reports(reports: DataFrame, folder: str | Path) -> None:
    """JSON and Markdown, best rated first."""
    rows = [r.asDict() for r in reports.orderBy(F.desc("rating"), "community_id").collect()]
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    (at / "communities.json").write_text(json.dumps(rows, ensure_ascii=False, indent=1), encoding="utf-8")
    parts = [f"# {r['title']} ({r['rating']})\n\n{r['summary']}\n\n" + "\n".join(f"- {x}" for x in r["findings"]) for r in rows]
    (at / "communities.md").write_text("\n\n".join(parts) + "\n", encoding="utf-8")


def global_answer(question: str, reports: DataFrame, ask: Callable[[str], str], least: int = 3) -> str:
    """Ask every report, drop those that have nothing to say, and ask once more over the rest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [ask(f"Question: {question}\n\nReport: {t}\n{s}\n\nAnswer from this report or say NOT RELEVANT.") or "" for t, s in zip(pdf["title"], pdf["summary"])]
            yield pd.DataFrame({"community_id": pdf["community_id"], "answer": got})

    big = reports.filter(F.col("members") >= least)
    parts = big.select("community_id", "title", "summary").mapInPandas(run, "community_id string, answer string").filter(~F.upper("answer").contains("NOT RELEVANT") & (F.trim("answer") != ""))
    answers = [r["answer"] for r in parts.orderBy("community_id").collect()]  # one short answer a report
    if not answers:
        return "No community report answers this question."
    return ask(f"Question: {question}\n\nPartial answers:\n" + "\n".join(f"- {a}" for a in answers))


def view_records(nodes: DataFrame, edges: DataFrame, min_degree: int = 0) -> tuple[DataFrame, DataFrame]:
    """Node and link records of a visualisation: size from the degree, colour from the kind, width from the weight."""
    d = graph.degree(edges)
    n = nodes.join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).filter(F.col("degree") >= min_degree)
    shown = n.select("id", "label", "kind", F.greatest(F.lit(1.0), 3 * F.sqrt("degree")).alias("val"), F.pmod(F.xxhash64(F.coalesce("community_id", "kind")), F.lit(12)).cast("int").alias("color"))
    keep = shown.select("id")
    links = edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return shown, links.select("src", "dst", "relation", F.greatest(F.lit(0.5), 1.5 * F.coalesce("weight", F.lit(1.0))).alias("width"))


def html(nodes: DataFrame, edges: DataFrame, path: str | Path, limit: int = 5000) -> None:
    """A self-contained page with the ``limit`` best linked nodes as a list of circles and lines."""
    shown, links = view_records(nodes, edges)
    rows = [r.asDict() for r in shown.orderBy(F.desc("val"), "id").limit(limit).collect()]
    ids = {r["id"] for r in rows}
    keep = shown.orderBy(F.desc("val"), "id").limit(limit).select("id")
    pairs = [r.asDict() for r in links.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").collect() if r["src"] in ids and r["dst"] in ids]
    data = json.dumps({"nodes": rows, "links": pairs}, ensure_ascii=False).replace("</", "<\\/")
    script = (
        "const c=document.querySelector('canvas'),g=c.getContext('2d');c.width=innerWidth;c.height=innerHeight;const p={};"
        "D.nodes.forEach((n,i)=>{const a=i*2.39996,r=14*Math.sqrt(i);p[n.id]=[c.width/2+r*Math.cos(a),c.height/2+r*Math.sin(a)]});"
        "D.links.forEach(l=>{g.lineWidth=l.width/3;g.strokeStyle='#8884';g.beginPath();g.moveTo(...p[l.src]);g.lineTo(...p[l.dst]);g.stroke()});"
        "D.nodes.forEach(n=>{g.fillStyle=`hsl(${n.color*30} 60% 50%)`;g.beginPath();g.arc(...p[n.id],Math.min(12,n.val),0,7);g.fill()})"
    )
    Path(path).write_text(f"<!doctype html><meta charset=utf-8><title>Graph</title><canvas></canvas><script>const D={data};{script}</script>\n", encoding="utf-8")


def canvas(nodes: DataFrame, edges: DataFrame, prefix: str = "", per_row: int = 4, width: int = 320, height: int = 60, gap: int = 40) -> dict:
    """Code nodes in a grid, a column a file, and one edge per pair: the records of a canvas file."""
    code = nodes.filter(F.col("kind").isin("module", "class", "function", "method") & F.col("source_file").startswith(prefix))
    order = F.when(F.col("kind") == "module", 0).when(F.col("kind") == "class", 1).otherwise(2)
    files = code.select("source_file").distinct().withColumn("f", F.row_number().over(Window.orderBy("source_file")) - 1)
    placed = code.join(files, "source_file").withColumn("row", F.row_number().over(Window.partitionBy("source_file").orderBy(order, "label", "id")) - 1)
    tall = placed.groupBy((F.col("f") / per_row).cast("int").alias("band")).agg((F.max("row") + 1).alias("rows"))
    base = tall.withColumn("y0", F.sum(F.col("rows") * (height + gap)).over(Window.orderBy("band")) - F.col("rows") * (height + gap)).select("band", "y0")
    spots = placed.withColumn("band", (F.col("f") / per_row).cast("int")).join(base, "band")
    rows = spots.select("id", F.col("label").alias("text"), ((F.col("f") % per_row) * (width + gap)).cast("int").alias("x"), (F.col("y0") + F.col("row") * (height + gap)).cast("int").alias("y")).orderBy("id").collect()
    ends = edges.filter(F.col("relation").isin("calls", "inherits", "imports")).join(code.select(F.col("id").alias("src")), "src", "left_semi").join(code.select(F.col("id").alias("dst")), "dst", "left_semi")
    one = ends.groupBy("src", "dst").agg(F.min("relation").alias("label")).orderBy("src", "dst").collect()
    return {"nodes": [{**r.asDict(), "type": "text", "width": width, "height": height} for r in rows], "edges": [{"id": f"{r['src']}>{r['dst']}", "fromNode": r["src"], "toNode": r["dst"], "label": r["label"]} for r in one]}
