"""Rules as a graph: node and edge tables, summaries, and exports."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import rule_key

SIGNATURES = ("antecedent", "consequent", "antecedent_consequent")


class RuleGraph:
    """``nodes(id, kind, name, group, measures...)`` and ``edges(source, target, relation)`` of a table of rules.

    Items and rules are nodes; edges lead from antecedent items to the rule and from the rule to consequent
    items. An item's group is the part of its name before the first ``_`` (or a given expression).
    """

    def __init__(self, rules: DataFrame, measures: Sequence[str] | None = None, item_group: Column | None = None) -> None:
        known = ("antecedents", "consequents")
        self.measures = list(measures) if measures is not None else [f.name for f in rules.schema if f.name not in known and isinstance(f.dataType, T.NumericType)]
        self.rules = rules.select(F.concat(F.lit("rule::"), rule_key()).alias("id"), *known, *self.measures).dropDuplicates(["id"])
        self.item_group = item_group
        self.summaries: list[DataFrame] = []

    @property
    def items(self) -> DataFrame:
        name = self.rules.select(F.explode(F.concat("antecedents", "consequents")).alias("id")).distinct()
        group = self.item_group if self.item_group is not None else F.when(F.contains("id", F.lit("_")), F.substring_index("id", "_", 1)).otherwise(F.lit("item"))
        return name.select("id", F.lit("item").alias("kind"), F.col("id").alias("name"), group.alias("group"))

    @property
    def nodes(self) -> DataFrame:
        rule = self.rules.select("id", F.lit("rule").alias("kind"), F.regexp_replace("id", "^rule::", "").alias("name"), F.lit("rule").alias("group"), *self.measures)
        out = self.items.unionByName(rule, allowMissingColumns=True)
        for s in self.summaries:
            out = out.unionByName(s.drop("antecedents", "consequents"), allowMissingColumns=True)
        return out

    @property
    def edges(self) -> DataFrame:
        tables = [self.rules, *self.summaries]
        out = None
        for t in tables:
            a = t.select(F.explode(F.coalesce("antecedents", F.array().cast("array<string>"))).alias("source"), F.col("id").alias("target"), F.lit("antecedent").alias("relation"))
            c = t.select(F.col("id").alias("source"), F.explode(F.coalesce("consequents", F.array().cast("array<string>"))).alias("target"), F.lit("consequent").alias("relation"))
            both = a.unionByName(c)
            out = both if out is None else out.unionByName(both)
        return out

    def summarize(self, signature: str = "antecedent_consequent", measures: Sequence[str] | None = None, quantiles: Sequence[float] = (0.25, 0.5, 0.75), exact: bool = True) -> DataFrame:
        """Adds and gives one node per group of rules of equal sides: count, members, extremes, mean and quantiles.

        ``exact`` quantiles interpolate; for groups of very many rules pass False for approximate ones of bounded memory.
        """
        if signature not in SIGNATURES:
            raise ValueError(f"signature must be one of {SIGNATURES}")
        keys = {"antecedent": ["antecedents"], "consequent": ["consequents"], "antecedent_consequent": ["antecedents", "consequents"]}[signature]
        rows = self.rules.select("id", *[F.array_sort(c).alias(c) for c in ("antecedents", "consequents")], *self.measures)
        aggs = []
        for m in measures or self.measures:
            aggs += [F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.avg(m).alias(f"{m}_mean")]
            aggs += [(F.percentile(m, q) if exact else F.percentile_approx(m, q)).alias(f"{m}_q{round(q * 100)}") for q in quantiles]
        out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rule_count"), F.array_sort(F.collect_list("id")).alias("members"), *aggs)
        for side in ("antecedents", "consequents"):
            if side not in keys:
                out = out.withColumn(side, F.lit(None).cast("array<string>"))
        key = F.concat_ws("=>", *[F.array_join(k, ",") for k in keys])
        out = out.select(F.concat(F.lit(f"summary::{signature}::"), key).alias("id"), F.lit("summary").alias("kind"), F.concat(F.lit("summary("), key, F.lit(")")).alias("name"), F.lit("summary").alias("group"), F.lit(signature).alias("signature"), *[c for c in out.columns])
        self.summaries.append(out)
        return out

    def selected(self, max_rules: int | None = None, sort_by: str | None = None) -> RuleGraph:
        """The graph of the best rules, their items, and summaries trimmed to them."""
        if max_rules is None:
            return self
        best = self.rules.orderBy(F.desc(sort_by or self.measures[0]), "id").limit(max_rules)
        out = RuleGraph.__new__(RuleGraph)
        out.measures, out.rules, out.item_group = self.measures, best, self.item_group
        ids = best.agg(F.collect_set("id").alias("_ids"))  # at most max_rules
        out.summaries = [s.crossJoin(F.broadcast(ids)).withColumn("members", F.array_intersect("members", "_ids")).drop("_ids").where(F.size("members") > 0) for s in self.summaries]
        return out

    # -- exports: rows of text or documents are made in the plan; strings for small graphs on the driver --

    def documents(self, max_rules: int | None = None, sort_by: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Tables of documents, to be written as JSON lines."""
        g = self.selected(max_rules, sort_by)
        return g.nodes.withColumnRenamed("id", "_id"), g.edges

    def jgf_rows(self) -> tuple[DataFrame, DataFrame]:
        n, e = self.nodes, self.edges
        meta = F.struct(*[F.col(f"`{c}`") for c in n.columns if c not in ("id", "name")])
        return n.select("id", F.to_json(F.struct(F.col("name").alias("label"), meta.alias("metadata"))).alias("node")), e.select(F.to_json(F.struct("source", "target", "relation")).alias("edge"))

    def to_jgf(self, max_rules: int | None = 5000, sort_by: str | None = None, indent: int | None = 2) -> str:
        """One JSON Graph Format string; for graphs that a viewer can show (``max_rules``)."""
        nodes, edges = self.selected(max_rules, sort_by).jgf_rows()
        body = {"directed": True, "type": "association-rules", "nodes": {r["id"]: json.loads(r["node"]) for r in nodes.orderBy("id").collect()}, "edges": [json.loads(r["edge"]) | {"metadata": {}} for r in edges.orderBy("edge").collect()]}
        return json.dumps({"graph": body}, indent=indent)

    def cypher(self, max_rules: int | None = None, sort_by: str | None = None) -> DataFrame:
        """``(statement)`` rows, nodes before edges by ``part``, for ``write.text``."""
        g = self.selected(max_rules, sort_by)
        n = g.nodes
        quoted = lambda c: F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\\\\\"), "'", r"\\\\'"), F.lit("'"))
        parts = [F.concat(F.lit("id: "), quoted(F.col("id"))), F.concat(F.lit("name: "), quoted(F.col("name")))]
        for f in n.schema:
            if f.name in ("id", "name", "kind"):
                continue
            c = F.col(f"`{f.name}`")
            value = F.concat(F.lit("["), F.array_join(F.transform(c, quoted), ", "), F.lit("]")) if isinstance(f.dataType, T.ArrayType) else c.cast("string") if isinstance(f.dataType, T.NumericType) else quoted(c)
            parts.append(F.when(c.isNotNull(), F.concat(F.lit(f"`{f.name}`: "), value)))
        label = F.initcap("kind")
        made = n.select(F.lit(0).alias("part"), F.concat(F.lit("CREATE (:"), label, F.lit(" {"), F.concat_ws(", ", *parts), F.lit("});")).alias("statement"))
        link = g.edges.select(F.lit(1).alias("part"), F.concat(F.lit("MATCH (a {id: "), quoted(F.col("source")), F.lit("}), (b {id: "), quoted(F.col("target")), F.lit("}) CREATE (a)-[:"), F.upper("relation"), F.lit("]->(b);")).alias("statement"))
        return made.unionByName(link)

    def to_graphml(self, max_rules: int | None = 5000, sort_by: str | None = None) -> str:
        g = self.selected(max_rules, sort_by)
        n = g.nodes
        names = [f.name for f in n.schema if f.name != "id"]
        kinds = {f.name: "double" if isinstance(f.dataType, T.NumericType) else "string" for f in n.schema}
        out = ['<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
        out += [f'<key id="{html.escape(c)}" for="node" attr.name="{html.escape(c)}" attr.type="{kinds[c]}"/>' for c in names]
        out += ['<key id="relation" for="edge" attr.name="relation" attr.type="string"/>', '<graph edgedefault="directed">']
        for r in n.orderBy("id").collect():
            data = "".join(f'<data key="{html.escape(c)}">{html.escape(str(r[c]))}</data>' for c in names if r[c] is not None)
            out.append(f'<node id="{html.escape(r["id"])}">{data}</node>')
        out += [f'<edge source="{html.escape(r["source"])}" target="{html.escape(r["target"])}"><data key="relation">{r["relation"]}</data></edge>' for r in g.edges.orderBy("source", "target").collect()]
        return "\n".join([*out, "</graph>", "</graphml>"])

    def to_dot(self, max_rules: int | None = 5000, sort_by: str | None = None) -> str:
        g = self.selected(max_rules, sort_by)
        text = lambda s: json.dumps(s, ensure_ascii=False)
        shape = {"item": "ellipse", "rule": "box", "summary": "hexagon"}
        out = ["digraph rules {"]
        out += [f"  {text(r['id'])} [label={text(r['name'])}, shape={shape[r['kind']]}];" for r in g.nodes.select("id", "name", "kind").orderBy("id").collect()]
        out += [f"  {text(r['source'])} -> {text(r['target'])} [relation={text(r['relation'])}];" for r in g.edges.orderBy("source", "target").collect()]
        return "\n".join([*out, "}"])

    def export(self, kind: int = 0):
        """0 JSON graph, 1 GraphML, 2 DOT, 3 the two tables."""
        return {0: self.to_jgf, 1: self.to_graphml, 2: self.to_dot, 3: lambda: (self.nodes, self.edges)}[kind]()

    def to_html(self, path: str | None = None, title: str = "Rule graph", max_rules: int = 500, sort_by: str | None = None, measure: str | None = None, min_value: float | None = None) -> str:
        """One page without outside resources: a force layout of the selected graph with a filter by a measure."""
        data = self.to_jgf(max_rules, sort_by, None).replace("</", "<\\/")
        page = _PAGE.replace("@TITLE@", html.escape(title)).replace("@MEASURE@", json.dumps(measure or (self.measures[0] if self.measures else ""))).replace("@MIN@", json.dumps(min_value)).replace("@DATA@", data)
        if path:
            with open(path, "w", encoding="utf-8") as file:
                file.write(page)
        return page


_PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>@TITLE@</title>
<style>body{margin:0;font:13px sans-serif}#bar{padding:6px}canvas{display:block}</style></head><body>
<div id="bar"><b>@TITLE@</b> <input id="find" placeholder="find"> <label>least <span id="what"></span> <input id="least" type="number" step="any"></label> <span id="info"></span></div>
<canvas id="c"></canvas><script>
const G=@DATA@.graph,M=@MEASURE@,MIN=@MIN@;
const c=document.getElementById('c'),x=c.getContext('2d'),find=document.getElementById('find'),least=document.getElementById('least'),info=document.getElementById('info');
document.getElementById('what').textContent=M;if(MIN!==null)least.value=MIN;
const N=Object.entries(G.nodes).map(([id,n],i)=>({id,label:n.label,m:n.metadata,x:Math.cos(i)*300,y:Math.sin(i)*300,u:0,v:0}));
const at=new Map(N.map(n=>[n.id,n]));const E=G.edges.map(e=>[at.get(e.source),at.get(e.target),e.relation]).filter(e=>e[0]&&e[1]);
const shown=n=>n.m.kind!=='rule'||least.value===''||!(n.m[M]<+least.value);
function step(){for(const a of N){for(const b of N){if(a===b)continue;const dx=a.x-b.x,dy=a.y-b.y,d=dx*dx+dy*dy+1;a.u+=600*dx/d;a.v+=600*dy/d}a.u-=a.x*.01;a.v-=a.y*.01}
for(const[a,b]of E){const dx=b.x-a.x,dy=b.y-a.y;a.u+=dx*.02;a.v+=dy*.02;b.u-=dx*.02;b.v-=dy*.02}
for(const n of N){if(n!==held){n.x+=Math.max(-9,Math.min(9,n.u));n.y+=Math.max(-9,Math.min(9,n.v))}n.u=n.v=0}}
let zoom=1,px=0,py=0,held=null,pan=null;const color={item:'#36c',rule:'#c63',summary:'#393'};
function draw(){c.width=innerWidth;c.height=innerHeight-40;x.translate(c.width/2+px,c.height/2+py);x.scale(zoom,zoom);x.strokeStyle='#bbb';
for(const[a,b]of E)if(shown(a)&&shown(b)){x.beginPath();x.moveTo(a.x,a.y);x.lineTo(b.x,b.y);x.stroke()}
for(const n of N)if(shown(n)){const hit=find.value&&n.label.includes(find.value);x.fillStyle=hit?'#e00':color[n.m.kind];x.beginPath();x.arc(n.x,n.y,n.m.kind==='rule'?4+6*(+n.m[M]||0):6,0,7);x.fill();if(n.m.kind==='item'||hit){x.fillStyle='#000';x.fillText(n.label,n.x+8,n.y+3)}}}
let k=0;function loop(){if(k++<300||held)step();draw();requestAnimationFrame(loop)}loop();
const spot=e=>[(e.offsetX-c.width/2-px)/zoom,(e.offsetY-c.height/2-py)/zoom];const near=e=>{const[a,b]=spot(e);return N.find(n=>shown(n)&&(n.x-a)**2+(n.y-b)**2<100)};
c.onmousedown=e=>{held=near(e)||null;if(!held)pan=[e.clientX-px,e.clientY-py]};onmouseup=()=>{held=pan=null};
c.onmousemove=e=>{if(held)[held.x,held.y]=spot(e);else if(pan){px=e.clientX-pan[0];py=e.clientY-pan[1]}const n=near(e);info.textContent=n?n.label+' '+Object.entries(n.m).filter(([k,v])=>typeof v==='number').map(([k,v])=>k+'='+v.toPrecision(4)).join(' '):''};
c.onwheel=e=>{zoom*=e.deltaY<0?1.1:.9;e.preventDefault()};
</script></body></html>
"""
