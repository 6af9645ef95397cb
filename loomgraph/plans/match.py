"""A bounded pattern-matching query language over a graph, planned into DataFrames.

    MATCH (a:Function {name: $x})-[r:CALLS*1..3]->(b) WHERE b.risk_score > 50 AND a.name =~ 'p.*'
    OPTIONAL MATCH ...  WITH ... UNWIND list AS x
    RETURN DISTINCT a.name AS caller, count(*) AS n ORDER BY n DESC LIMIT 10

Patterns become equi-joins through the edge table; a second MATCH joins on the variables that it shares. A variable-length
step is a union of chained joins that keep each trail's edges apart, so edges don't repeat on a path; where a statement
returns only DISTINCT ends and names no path, reachability is planned instead, which keeps one row a pair. Anything outside
this language is refused. Unbounded steps in a trail are refused too; a distinct end is found by the closure."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph
from loomgraph.operators.paths import reachable, reverse

TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+\.\d+|\d+)|(?P<id>[A-Za-z_]\w*|`[^`]+`)|(?P<par>\$\w+)|(?P<op><=|>=|<>|=~|->|<-|\.\.|[-+*/%=<>(){}\[\],.:|]))")
WORDS = {"MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "ORDER", "BY", "LIMIT", "SKIP", "AS", "AND", "OR", "NOT", "IN", "IS", "NULL", "DISTINCT", "UNWIND", "DESC", "ASC", "CONTAINS", "STARTS", "ENDS", "TRUE", "FALSE", "ALL"}
AGGREGATES = {"count", "sum", "min", "max", "avg", "collect"}
MAX_DEPTH = 10


class Refused(ValueError):
    """The statement is outside the language."""


@dataclass
class Step:
    types: list[str]
    low: int
    high: int | None
    forward: bool | None
    var: str | None
    ranged: bool
    right: NodeP


@dataclass
class NodeP:
    var: str
    labels: list[str]
    props: dict
    named: bool


@dataclass
class Pattern:
    first: NodeP
    steps: list[Step]
    path: str | None = None


@dataclass
class State:
    df: DataFrame | None = None
    nodes: set[str] = field(default_factory=set)
    rels: dict[str, bool] = field(default_factory=dict)  # variable -> variable length
    paths: set[str] = field(default_factory=set)
    values: set[str] = field(default_factory=set)


class Planner:
    def __init__(self, graph: Graph, text: str, params: dict | None = None):
        self.g, self.params, self.at, self.fresh = graph, params or {}, 0, 0
        self.toks: list[tuple[str, str]] = []
        i = 0
        text = re.sub(r"//[^\n]*", "", text).strip().rstrip(";")
        while i < len(text):
            m = TOKEN.match(text, i)
            if not m or m.end() == i:
                if text[i:].strip():
                    raise Refused(f"cannot read {text[i : i + 20]!r}")
                break
            kind = m.lastgroup
            v = m.group(kind)
            self.toks.append(("kw", v.upper()) if kind == "id" and v.upper() in WORDS else (kind, v.strip("`") if kind == "id" else v))
            i = m.end()
        self.distinct_ends = bool(re.search(r"RETURN\s+DISTINCT", text, re.I)) and not re.search(r"\b(length|nodes|relationships)\s*\(", text, re.I)

    # --- tokens
    def peek(self, *v: str, ahead: int = 0) -> bool:
        return self.at + ahead < len(self.toks) and self.toks[self.at + ahead][1] in v and self.toks[self.at + ahead][0] in ("kw", "op")

    def take(self, *v: str) -> bool:
        if self.peek(*v):
            self.at += 1
            return True
        return False

    def need(self, v: str) -> None:
        if not self.take(v):
            raise Refused(f"expected {v} at {' '.join(t for _, t in self.toks[self.at : self.at + 5])!r}")

    def kind(self) -> str:
        return self.toks[self.at][0] if self.at < len(self.toks) else ""

    def word(self) -> str:
        k, v = self.toks[self.at] if self.at < len(self.toks) else ("", "")
        if k not in ("id", "kw"):
            raise Refused(f"expected a name, got {v!r}")
        self.at += 1
        return v

    def new(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}"

    # --- patterns
    def node(self) -> NodeP:
        self.need("(")
        var = self.word() if self.kind() == "id" else None
        labels, props = [], {}
        while self.take(":", "|"):
            labels.append(self.word())
        if self.take("{"):
            while not self.take("}"):
                k = self.word()
                self.need(":")
                props[k] = self.literal()
                self.take(",")
        self.need(")")
        return NodeP(var or self.new(), labels, props, var is not None)

    def literal(self):
        k, v = self.toks[self.at]
        self.at += 1
        if k == "str":
            return re.sub(r"\\(.)", r"\1", v[1:-1])
        if k == "num":
            return float(v) if "." in v else int(v)
        if k == "par":
            if v[1:] not in self.params:
                raise Refused(f"no value for {v}")
            return self.params[v[1:]]
        if (k, v) in (("kw", "TRUE"), ("kw", "FALSE")):
            return v == "TRUE"
        if v == "[":
            out = []
            while not self.take("]"):
                out.append(self.literal())
                self.take(",")
            return out
        raise Refused(f"expected a literal, got {v!r}")

    def pattern(self) -> Pattern:
        path = None
        if self.kind() == "id" and self.peek("=", ahead=1):
            path = self.word()
            self.need("=")
        p = Pattern(self.node(), [], path)
        while self.peek("-", "<-"):
            back = self.toks[self.at][1] == "<-"
            self.at += 1
            types, low, high, var, ranged = [], 1, 1, None, False
            if self.take("["):
                if self.kind() == "id":
                    var = self.word()
                while self.take(":", "|"):
                    types.append(self.word())
                if self.take("*"):
                    ranged, low, high = True, 1, None
                    if self.kind() == "num":
                        low = high = int(self.literal())
                    if self.take(".."):
                        high = int(self.literal()) if self.kind() == "num" else None
                self.need("]")
            if self.take("->"):
                forward = None if back else True
            else:
                self.need("-")
                forward = False if back else None
            p.steps.append(Step(types, low, high, forward, var, ranged, self.node()))
        return p

    def bind(self, df: DataFrame | None, n: NodeP, st: State) -> DataFrame:
        """The nodes of n as the column n.var, or the rows of df whose n.var fits."""
        cond = F.lit(True)
        src = self.g.nodes
        get = (lambda c: F.col(c)) if n.var not in st.nodes else (lambda c: F.col(n.var)[c])
        if n.labels:
            cond = cond & get("label").isin(*n.labels)
        for k, v in n.props.items():
            cond = cond & (get(k) == F.lit(v))
        if n.var in st.nodes:
            return df.filter(cond)
        return src.filter(cond).select(F.struct(*src.columns).alias(n.var))

    def hop(self, st: State, df: DataFrame, left: NodeP, s: Step, names: list[str], named: bool) -> DataFrame:
        e = self.g.edges
        if s.types:
            e = e.filter(F.col("type").isin(*s.types))
        if s.forward is False:
            e = reverse(e)
        elif s.forward is None:
            e = e.unionByName(reverse(e))
        cols = [c for c in e.columns if c not in ("src", "dst")]
        rel = s.var or self.new()
        edge = F.struct("src", "dst", *cols)
        known = s.right.var in st.nodes
        right = None if known else self.bind(None, s.right, st)
        end = f"_end{self.new()}"
        if not s.ranged:
            steps = e.select(F.col("src").alias("_s"), F.col("dst").alias(end), edge.alias(rel))
            df = df.join(steps, F.col(left.var)["id"] == F.col("_s")).drop("_s")
            st.rels[rel] = False
        elif s.forward is not None and self.distinct_ends and not s.var and not named and s.low == 1:
            starts = df.select(F.col(left.var)["id"].alias("id")).distinct()
            pairs = closure_pairs(e, starts) if s.high is None else reachable(e, starts, s.high)
            df = df.join(pairs.select(F.col("start").alias("_s"), F.col("end").alias(end)), F.col(left.var)["id"] == F.col("_s")).drop("_s")
        else:
            if s.high is None or s.high > MAX_DEPTH:
                raise Refused(f"a trail needs an upper bound of at most {MAX_DEPTH}")
            # undirected ones too, where reachability would walk an edge back and forth
            cur = df.withColumn(rel, F.array().cast(e.select(F.array(edge).alias("x")).schema["x"].dataType)).withColumn(end, F.col(left.var)["id"])
            out = cur if s.low == 0 else None
            for d in range(1, s.high + 1):
                steps = e.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), edge.alias("_e"))  # anew, so that its columns are not those of the step before
                cur = cur.join(steps, F.col(end) == F.col("_a")).filter(~F.exists(rel, lambda x: _same(x, F.col("_e"), s.forward is None)))
                cur = cur.withColumn(rel, F.concat(rel, F.array("_e"))).withColumn(end, F.col("_b")).drop("_a", "_b", "_e")
                if d >= s.low:
                    out = cur if out is None else out.unionByName(cur)
            df = out
            st.rels[rel] = True
        names.append(rel)
        if known:
            df = self.bind(df.filter(F.col(end) == F.col(s.right.var)["id"]), s.right, st)
        else:
            df = df.join(right, F.col(end) == F.col(s.right.var)["id"])
            st.nodes.add(s.right.var)
        return df.drop(end)

    def match(self, st: State, optional: bool) -> None:
        pats = [self.pattern()]
        while self.take(","):
            pats.append(self.pattern())
        where = None
        mark = self.at
        if self.take("WHERE"):
            where = mark + 1
        for p in pats:
            sub = State(st.df, set(st.nodes), dict(st.rels), set(st.paths), set(st.values))
            before = set(st.nodes)
            known = p.first.var in st.nodes
            base = self.bind(st.df, p.first, st) if known else self.bind(None, p.first, sub)
            keep = st.df
            if not known or optional:
                # matched apart, then joined on the shared variables
                sub = State(None, set(), {}, set(), set())
                df = self.bind(None, p.first, sub)
                sub.nodes.add(p.first.var)
            else:
                df, sub = base, st
            left, names = p.first, []
            for s in p.steps:
                df = self.hop(sub, df, left, s, names, bool(p.path))
                left = s.right
            if p.path:
                parts = [F.col(r) if sub.rels[r] else F.array(r) for r in names if r in sub.rels]
                df = df.withColumn(p.path, F.concat(*parts) if parts else F.array())
                sub.paths.add(p.path)
            if sub is not st:
                if optional and where is not None:
                    at, self.at = self.at, where
                    df = df.filter(self.expr(sub))
                    end, self.at = self.at, at
                shared = sorted(sub.nodes & before)
                if keep is not None:
                    if not shared:
                        raise Refused("a pattern that shares no variable with those before it would be a cross product")
                    cond = F.lit(True)
                    for v in shared:
                        df = df.withColumnRenamed(v, f"_r_{v}")
                        cond = cond & (F.col(v)["id"] == F.col(f"_r_{v}")["id"])
                    df = keep.join(df, cond, "left" if optional else "inner").drop(*(f"_r_{v}" for v in shared))
                st.nodes |= sub.nodes
                st.rels |= sub.rels
                st.paths |= sub.paths
            st.df = df
        if where is not None:
            if optional:
                self.at = end
            else:
                self.at = where
                st.df = st.df.filter(self.expr(st))

    # --- expressions
    def expr(self, st: State) -> Column:
        c = self.conj(st)
        while self.take("OR"):
            c = c | self.conj(st)
        return c

    def conj(self, st: State) -> Column:
        c = self.neg(st)
        while self.take("AND"):
            c = c & self.neg(st)
        return c

    def neg(self, st: State) -> Column:
        return ~self.neg(st) if self.take("NOT") else self.comparison(st)

    def comparison(self, st: State) -> Column:
        if self.take("ALL"):
            self.need("(")
            var = self.word()
            self.need("IN")
            xs = self.sum(st)
            self.need("WHERE")
            c = self.over(st, xs, var, self.expr, F.forall)
            self.need(")")
            return c
        if self.kind() == "id" and self.peek(":", ahead=1) and self.toks[self.at][1] in st.nodes:
            v = self.word()
            self.need(":")
            return F.col(v)["label"] == self.word()
        a = self.sum(st)
        if self.take("IS"):
            no = self.take("NOT")
            self.need("NULL")
            return a.isNotNull() if no else a.isNull()
        if self.take("IN"):
            mark = self.at
            try:
                xs = self.literal()
                return a.isin(*xs)
            except Refused:
                self.at = mark
                return F.array_contains(self.sum(st), a)
        if self.take("=~"):
            return a.rlike("^(?:" + str(self.literal()) + ")$")
        if self.take("CONTAINS"):
            return a.contains(self.sum(st))
        if self.take("STARTS"):
            self.need("WITH")
            return a.startswith(self.sum(st))
        if self.take("ENDS"):
            self.need("WITH")
            return a.endswith(self.sum(st))
        for op, f in (("=", lambda x, y: x == y), ("<>", lambda x, y: x != y), ("<=", lambda x, y: x <= y), (">=", lambda x, y: x >= y), ("<", lambda x, y: x < y), (">", lambda x, y: x > y)):
            if self.take(op):
                return f(a, self.sum(st))
        return a

    def sum(self, st: State) -> Column:
        a = self.product(st)
        while self.peek("+", "-"):
            op = self.toks[self.at][1]
            self.at += 1
            b = self.product(st)
            a = a + b if op == "+" else a - b
        return a

    def product(self, st: State) -> Column:
        a = self.postfix(st)
        while self.peek("*", "/", "%"):
            op = self.toks[self.at][1]
            self.at += 1
            b = self.postfix(st)
            a = a * b if op == "*" else a / b if op == "/" else a % b
        return a

    def postfix(self, st: State) -> Column:
        a = self.atom(st)
        while True:
            if self.take("."):
                a = a[self.word()]
            elif self.take("["):
                low = None if self.peek("..") else self.literal()
                if self.take(".."):
                    high = None if self.peek("]") else self.literal()
                    n = F.size(a)
                    a = F.slice(a, (low or 0) + 1, F.greatest(F.lit(0), (n if high is None else F.least(n, F.lit(high))) - (low or 0)))
                else:
                    a = F.get(a, F.lit(low))
                self.need("]")
            else:
                return a

    def over(self, st: State, xs: Column, var: str, parse, apply) -> Column:
        start, end = self.at, [self.at]

        def body(x: Column) -> Column:
            self.at = start
            self.lambdas = {**getattr(self, "lambdas", {}), var: x}
            c = parse(st)
            self.lambdas = {k: v for k, v in self.lambdas.items() if k != var}
            end[0] = self.at
            return c

        c = apply(xs, body)
        self.at = end[0]
        return c

    def atom(self, st: State) -> Column:
        if self.take("("):
            c = self.expr(st)
            self.need(")")
            return c
        if self.peek("[") and self.peek("IN", ahead=2):
            self.need("[")
            var = self.word()
            self.need("IN")
            xs = self.sum(st)
            self.need("|")
            c = self.over(st, xs, var, self.expr, F.transform)
            self.need("]")
            return c
        if self.kind() in ("str", "num", "par") or self.peek("TRUE", "FALSE", "["):
            v = self.literal()
            return F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
        if self.take("NULL"):
            return F.lit(None)
        name = self.word()
        if self.take("("):
            return self.call(st, name)
        if name in getattr(self, "lambdas", {}):
            return self.lambdas[name]
        if name in st.nodes or name in st.rels or name in st.paths or name in st.values:
            return F.col(name)
        raise Refused(f"unknown variable {name}")

    def call(self, st: State, name: str) -> Column:
        low = name.lower()
        distinct = self.take("DISTINCT")
        if low == "count" and self.take("*"):
            self.need(")")
            return F.count("*")
        if low in ("labels", "type", "properties", "length", "nodes", "relationships", "id"):
            a = self.expr(st)
            self.need(")")
            return {"labels": lambda: F.array(a["label"]), "type": lambda: a["type"], "properties": lambda: F.to_json(a), "length": lambda: F.size(a), "relationships": lambda: a, "id": lambda: a["id"],
                    "nodes": lambda: F.when(F.size(a) > 0, F.concat(F.array(F.get(a, F.lit(0))["src"]), F.transform(a, lambda x: x["dst"])))}[low]()
        args = [self.expr(st)]
        while self.take(","):
            args.append(self.expr(st))
        self.need(")")
        if low in AGGREGATES:
            if low == "collect":
                return F.collect_set(args[0]) if distinct else F.collect_list(args[0])
            if distinct and low == "count":
                return F.countDistinct(args[0])
            return getattr(F, low)(args[0])
        fs = {"tolower": F.lower, "toupper": F.upper, "coalesce": F.coalesce, "size": F.size, "abs": F.abs, "trim": F.trim, "tostring": lambda x: x.cast("string"), "tointeger": lambda x: x.cast("long"), "head": lambda x: F.get(x, F.lit(0)), "exists": lambda x: x.isNotNull()}
        if low == "split":
            return F.split(args[0], F.concat(F.lit("\\Q"), args[1], F.lit("\\E")))
        if low not in fs:
            raise Refused(f"unknown function {name}")
        return fs[low](*args)

    # --- clauses
    def items(self, st: State) -> list[tuple[str, Column, bool]]:
        out = []
        while True:
            start = self.at
            c = self.expr(st)
            toks = self.toks[start : self.at]
            text = "".join(t for _, t in toks)
            agg = any(k == "id" and t.lower() in AGGREGATES and i + 1 < len(toks) and toks[i + 1][1] == "(" for i, (k, t) in enumerate(toks))
            out.append((self.word() if self.take("AS") else text, c, agg))
            if not self.take(","):
                return out

    def project(self, st: State, last: bool) -> None:
        distinct = self.take("DISTINCT")
        items = self.items(st)
        if any(a for _, _, a in items):
            keys = [c.alias(n) for n, c, a in items if not a]
            df = st.df.groupBy(*keys).agg(*(c.alias(n) for n, c, a in items if a)).select(*(F.col(f"`{n}`") for n, _, _ in items))
        else:
            df = st.df.select(*(c.alias(n) for n, c, _ in items))
        if distinct:
            df = df.distinct()
        plain = {n for n, _, _ in items}
        nodes = {n for n in plain if n in st.nodes and not last}
        new = State(df, nodes, {n: v for n, v in st.rels.items() if n in plain}, st.paths & plain, plain - nodes)
        if self.take("ORDER"):
            self.need("BY")
            keys = []
            while True:
                mark = self.at
                name = None
                for n in sorted(plain, key=len, reverse=True):  # a returned expression may be named by its text
                    t, i = "", self.at
                    while i < len(self.toks) and len(t) < len(n):
                        t += self.toks[i][1]
                        i += 1
                    if t == n:
                        name, self.at = n, i
                        break
                c = F.col(f"`{name}`") if name else None
                if c is None:
                    self.at = mark
                    c = self.expr(new)
                down = self.take("DESC")
                if not down:
                    self.take("ASC")
                keys.append(c.desc_nulls_first() if down else c.asc_nulls_last())
                if not self.take(","):
                    break
            new.df = new.df.orderBy(*keys)
        if self.take("SKIP"):
            new.df = new.df.offset(int(self.literal()))
        if self.take("LIMIT"):
            new.df = new.df.limit(int(self.literal()))
        if not last and self.take("WHERE"):
            new.df = new.df.filter(self.expr(new))
        st.df, st.nodes, st.rels, st.paths, st.values = new.df, new.nodes, new.rels, new.paths, new.values

    def plan(self) -> DataFrame:
        st = State()
        while self.at < len(self.toks):
            if self.take("OPTIONAL"):
                self.need("MATCH")
                self.match(st, True)
            elif self.take("MATCH"):
                self.match(st, False)
            elif self.take("UNWIND"):
                c = self.expr(st)
                self.need("AS")
                v = self.word()
                if st.df is None:
                    st.df = self.g.nodes.sparkSession.range(1).select(F.explode(c).alias(v))
                else:
                    st.df = st.df.withColumn(v, F.explode(c))
                st.values.add(v)
            elif self.take("WITH"):
                self.project(st, False)
            elif self.take("RETURN"):
                self.project(st, True)
                if self.at < len(self.toks):
                    raise Refused(f"nothing may follow RETURN: {self.toks[self.at][1]}")
                return st.df
            else:
                raise Refused(f"unknown clause {self.toks[self.at][1]}")
        raise Refused("no RETURN")


def _same(x: Column, e: Column, either: bool) -> Column:
    same = (x["src"] == e["src"]) & (x["dst"] == e["dst"]) & (x["type"] == e["type"])
    return same | ((x["src"] == e["dst"]) & (x["dst"] == e["src"]) & (x["type"] == e["type"])) if either else same


def closure_pairs(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, end) over any number of edges, round by round until nothing is new."""
    from loomgraph.plans.storage import stored

    e = stored(edges.select("src", "dst").distinct(), "edges")
    front = stored(starts.select(F.col("id").alias("start"), F.col("id").alias("end")), "front")
    seen = None
    while True:
        nxt = front.join(e, F.col("end") == F.col("src")).select("start", F.col("dst").alias("end")).distinct()
        front = stored(nxt if seen is None else nxt.join(seen, ["start", "end"], "left_anti"), "front")
        if front.isEmpty():
            return front if seen is None else seen
        seen = front if seen is None else seen.unionByName(front)


PROCEDURES = {"labels": "label", "relationshiptypes": "relationshipType", "propertykeys": "propertyKey"}


def procedure(graph: Graph, name: str, column: str | None = None) -> DataFrame:
    """The labels, edge types or property names in use, in order."""
    own = PROCEDURES.get(name.lower())
    if own is None:
        raise Refused(f"unknown procedure db.{name}")
    if own == "label":
        out = graph.nodes.select(F.col("label").alias(own)).distinct()
    elif own == "relationshipType":
        out = graph.edges.select(F.col("type").alias(own)).distinct()
    else:
        out = None
        for df, fixed in ((graph.nodes, ("label", "seq")), (graph.edges, ("src", "dst", "type", "seq"))):
            used = [c for c in df.columns if c not in fixed]
            has = df.agg(*(F.max(F.col(c).isNotNull()).alias(c) for c in used)) if used else None
            keys = has.select(F.explode(F.array_compact(F.array(*(F.when(F.col(c), F.lit(c)) for c in used)))).alias(own)) if used else None
            out = keys if out is None or keys is None else out.unionByName(keys).distinct()
    return out.orderBy(own).withColumnRenamed(own, column or own)


def run(graph: Graph, statement: str, params: dict | None = None) -> DataFrame:
    """The rows of a statement over graph.nodes(id, label, ...) and graph.edges(src, dst, type, ...), or of a procedure:
    CALL db.labels(), db.relationshipTypes() or db.propertyKeys(), with a YIELD if wanted."""
    m = re.fullmatch(r"(?is)\s*CALL\s+db\.(\w+)\s*\(\s*\)\s*(?:YIELD\s+(\w+)\s*)?(?:RETURN\s+(\w+)(?:\s+AS\s+(\w+))?\s*)?;?\s*", statement)
    if m:
        return procedure(graph, m[1], m[4] or m[3] or m[2])
    return Planner(graph, statement, params).plan()
