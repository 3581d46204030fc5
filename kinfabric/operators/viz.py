"""Presentation of graphs: node colours and sizes, edges, and a self-contained page."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfabric.operators.graph import Graph


def node_color(value: Column, most: Column) -> Column:
    """From blue over green to red with the share of the largest value; grey where that is 0."""
    share = value / F.when(most > 0, most)
    h = (1 - share) * 0.7 * 6
    s, v = 0.8, 0.9
    i = F.floor(h)
    f = h - i
    p, q, t = F.lit(v * (1 - s)), v * (1 - f * s), v * (1 - s * (1 - f))
    full = F.lit(v)
    red = F.when(i == 0, full).when(i == 1, q).when(i.isin(2, 3), p).when(i == 4, t).otherwise(full)
    green = F.when(i == 0, t).when(i.isin(1, 2), full).when(i == 3, q).otherwise(p)
    blue = F.when(i.isin(0, 1), p).when(i == 2, t).when(i.isin(3, 4), full).otherwise(q)
    two = lambda c: F.lpad(F.lower(F.hex(F.floor(c * 255).cast("long"))), 2, "0")
    return F.when(share.isNull(), "#888888").otherwise(F.concat(F.lit("#"), two(red), two(green), two(blue)))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def _lines(column: str) -> Column:
    """``key: value`` lines of a JSON object in order of its keys; ``no metadata`` for an empty one."""
    pairs = F.map_entries(F.from_json(column, "map<string,string>"))
    said = F.array_join(F.transform(pairs, lambda x: F.concat(x["key"], F.lit(": "), F.coalesce(x["value"], F.lit("None")))), "\n")
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) > 0, said).otherwise("no metadata")


def viz_nodes(graph: Graph) -> DataFrame:
    """(node_id, degree, color, size, font_size, title)."""
    pairs = graph.edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    about = _lines("metadata") if "metadata" in graph.nodes.columns else F.lit("no metadata")
    rows = graph.nodes.select("node_id", about.alias("about")).join(ends, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    whole = rows.agg(F.max("degree").alias("most"), F.count("*").alias("n"))
    rows = rows.join(F.broadcast(whole))  # one row
    scaled = lambda top, each: top / F.greatest(F.lit(1.0), F.col("n") / each)
    base, bonus = clamp(scaled(100, 20), 15.0, 30.0), clamp(scaled(200, 10), 20.0, 50.0)
    share = F.coalesce(F.col("degree") / F.when(F.col("most") > 0, F.col("most")), F.lit(0.0))
    title = F.concat("node_id", F.lit("\nconnections: "), F.col("degree").cast("string"), F.lit("\n--- metadata ---\n"), "about")
    return rows.select(
        "node_id", "degree", node_color(F.col("degree"), F.col("most")).alias("color"), (base + share * bonus).alias("size"),
        clamp(scaled(50, 30), 12.0, 18.0).alias("font_size"), title.alias("title"),
    )


def viz_edges(graph: Graph) -> DataFrame:
    """(a, b, directed): one row for each unordered pair; directed if one of its edges is."""
    e = graph.edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "directed")
    return e.groupBy("a", "b").agg(F.max("directed").alias("directed"))


def edge_style(graph: Graph) -> DataFrame:
    """(source, target, directed, weight, width, color, dashes, title): how each edge is drawn; an edge without a weight has 1."""
    n = graph.nodes.agg(F.count("*").alias("n"))
    weight = F.coalesce(F.get_json_object("metadata", "$.weight").cast("double"), F.lit(1.0)) if "metadata" in graph.edges.columns else F.lit(1.0)
    rows = graph.edges.withColumn("weight", weight).join(F.broadcast(n))  # one row
    said = F.concat(
        F.when(F.col("directed"), "directed").otherwise("undirected"), F.lit(" edge\nfrom: "), "source", F.lit("\nto: "), "target",
        F.lit("\nweight: "), F.format_string("%.2f", "weight"),
    )
    width = clamp(10 / F.greatest(F.lit(1.0), F.col("n") / 50), 1.0, 4.0)
    return rows.select("source", "target", "directed", "weight", width.alias("width"), F.when(F.col("directed"), "#aaaaaa").otherwise("#888888").alias("color"), (~F.col("directed")).alias("dashes"), said.alias("title"))


def physics(n: int) -> dict:
    """Fixed values of the layout by the number of nodes."""
    gravity, length, constant = (-2000, 150, 0.04) if n <= 50 else (-4000, 200, 0.02) if n <= 200 else (-6000, 250, 0.01)
    return {
        "gravitationalConstant": gravity, "springLength": length, "springConstant": constant, "centralGravity": 0.1, "damping": 0.2,
        "avoidOverlap": 0.5, "iterations": min(300, max(100, 2 * n)), "updateInterval": 50,
    }


def html(graph: Graph, most_nodes: int = 2000, title: str = "graph") -> str:
    """A page with a search box and the titles under the pointer; for graphs that a browser can show (raises beyond ``most_nodes``)."""
    nodes = [r.asDict() for r in viz_nodes(graph).limit(most_nodes + 1).collect()]
    if not nodes:
        raise ValueError("the graph is empty")
    if len(nodes) > most_nodes:
        raise ValueError(f"more than {most_nodes} nodes; export viz_nodes and edge_style instead")
    data = json.dumps({"nodes": nodes, "edges": [r.asDict() for r in edge_style(graph).collect()], "physics": physics(len(nodes))}).replace("</", "<\\/")
    name = title.replace("&", "&amp;").replace("<", "&lt;")
    return (
        f"<!doctype html><meta charset=utf-8><title>{name}</title><style>body{{background:#121212;color:#fff;font-family:Arial}}</style>"
        "<input id=q placeholder=search><canvas id=c width=1200 height=900></canvas><pre id=t></pre><script>\n"
        f"const g={data};\n"
        "const el=document.getElementById('c'),c=el.getContext('2d'),at={},p=g.physics;\n"
        "g.nodes.forEach((n,i)=>{const t=2*Math.PI*i/g.nodes.length;at[n.node_id]=[600+420*Math.cos(t),450+420*Math.sin(t),0,0]});\n"
        # springs along edges, repulsion, a pull to the middle; a fixed number of steps
        "const es=g.edges.filter(e=>at[e.source]&&at[e.target]),ids=Object.values(at);\n"
        "for(let k=0;k<p.iterations;k++){for(const a of ids)for(const b of ids)if(a!==b){const dx=a[0]-b[0],dy=a[1]-b[1],d=Math.max(25,dx*dx+dy*dy);"
        "a[2]-=p.gravitationalConstant*dx/d/60;a[3]-=p.gravitationalConstant*dy/d/60}\n"
        "for(const e of es){const a=at[e.source],b=at[e.target],dx=b[0]-a[0],dy=b[1]-a[1],d=Math.hypot(dx,dy)||1,f=p.springConstant*(d-p.springLength)/d;a[2]+=dx*f;a[3]+=dy*f;b[2]-=dx*f;b[3]-=dy*f}\n"
        "for(const a of ids){a[2]+=(600-a[0])*p.centralGravity/10;a[3]+=(450-a[1])*p.centralGravity/10;a[2]*=1-p.damping;a[3]*=1-p.damping;"
        "a[0]+=Math.max(-20,Math.min(20,a[2]));a[1]+=Math.max(-20,Math.min(20,a[3]))}}\n"
        "function draw(q){c.clearRect(0,0,1200,900);for(const e of es){c.strokeStyle=e.color;c.lineWidth=e.width;c.setLineDash(e.dashes?[6,4]:[]);"
        "c.beginPath();c.moveTo(at[e.source][0],at[e.source][1]);c.lineTo(at[e.target][0],at[e.target][1]);c.stroke()}\n"
        "c.setLineDash([]);for(const n of g.nodes){c.globalAlpha=!q||n.node_id.includes(q)?1:.15;c.fillStyle=n.color;c.beginPath();c.arc(at[n.node_id][0],at[n.node_id][1],n.size/4,0,7);c.fill();"
        "c.fillStyle='#fff';c.font=n.font_size+'px Arial';c.fillText(n.node_id,at[n.node_id][0]+n.size/4,at[n.node_id][1])}c.globalAlpha=1}\n"
        "el.onmousemove=e=>{const n=g.nodes.find(n=>Math.hypot(at[n.node_id][0]-e.offsetX,at[n.node_id][1]-e.offsetY)<n.size/4);document.getElementById('t').textContent=n?n.title:''};\n"
        "document.getElementById('q').oninput=e=>draw(e.target.value);draw('')</script>"
    )


def html_of_file(spark: SparkSession, path: str, **options) -> str:
    """:func:`html` of a graph document."""
    return html(Graph.from_json(spark, path), **options)


def highlight(graph: Graph, node_id: str) -> DataFrame:
    """(node_id, hops): the node, its neighbours and theirs."""
    nbr = graph.neighbors()
    one = nbr.where(F.col("node_id") == node_id).select(F.col("nbr").alias("node_id"), F.lit(1).alias("hops"))
    two = one.join(nbr, "node_id").select(F.col("nbr").alias("node_id"), F.lit(2).alias("hops"))
    me = graph.get_node(node_id).select("node_id", F.lit(0).alias("hops"))
    return me.unionByName(one).unionByName(two).groupBy("node_id").agg(F.min("hops").alias("hops"))


def filtered(graph: Graph, column: str, values: list) -> tuple[DataFrame, DataFrame]:
    """Nodes whose property is one of ``values``; and, if ``column`` is one of the edges, both ends of such edges.

    Returns (node_id of the selected nodes, edges with both ends selected).
    """
    if column in graph.nodes.columns:
        picked = graph.nodes.where(F.col(column).isin(values)).select("node_id").distinct()
    elif column in graph.edges.columns:
        rows = graph.edges.where(F.col(column).isin(values))
        picked = rows.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    else:
        raise ValueError(f"neither nodes nor edges have {column}")
    ends = [picked.withColumnRenamed("node_id", c) for c in ("source", "target")]
    return picked, graph.edges.join(ends[0], "source", "left_semi").join(ends[1], "target", "left_semi")
