"""The query language compiled to DataFrame plans.

Each clause maps a DataFrame to a DataFrame: one struct column per node or relation variable, so properties need no further join. Single
hops are plain joins that Spark orders and prunes as it likes, patterns in WHERE become semi and anti joins; only paths of
variable length run level by level.

Two points differ from a literal reading of bindings as lists: a variable that comes up again is the same thing (a join), and all
constraints on a node count wherever it stands. Patterns of one MATCH have to share a variable with what is bound, as there are no
cross joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import matches
from ..functions.selector import SelectorError, select
from ..graph import CodeGraph
from ..model import CALL_FAMILY, CONFIDENCES, NODE_KINDS
from ..operators import walk
from ..session import cut
from .cql_syntax import Call, CqlError, Match, NodePattern, Pattern, Projection, RelPattern, parse

# Relationship types and the edge kinds behind them.
TYPES = {
    "CALLS": CALL_FAMILY[:6], "SPAWNS": ("spawns",), "DATA_FLOW": ("derives-from",), "MEMBER_OF": ("contains",), "CONTAINS": ("contains",), "OVERRIDES": ("overrides",), "INHERITS": ("inherits",),
    "IMPLEMENTS": ("implements",), "IMPORTS": ("imports",), "REFERENCES": ("references",), "INSTANTIATES": ("instantiates",), "THROWS": ("throws",), "CATCHES": ("catches",), "READS_FIELD": ("reads-field",), "WRITES_FIELD": ("writes-field",),
}
NODE_PROPS = {"name": "fqn", "fqn": "fqn", "file": "file", "line": "line_start", "kind": "kind"}
EDGE_PROPS = ("condition", "confidence", "kind")
#: Hops of a path without an upper bound, and of procedures.
MOST_HOPS = 8
_NODE = ("nid", "fqn", "file", "line_start", "kind", "lang")
_EDGE = ("eid", "kind", "condition", "confidence")


@dataclass
class Result:
    """rows: the answer. ordered: columns and directions it is sorted by, hidden ones included."""

    rows: DataFrame
    columns: list[str]


class Compiler:
    def __init__(self, graph: CodeGraph, max_rows: int | None = None):
        self.g, self.max_rows = graph, max_rows
        self.types: dict[str, str] = {}
        self.df: DataFrame | None = None
        self.fresh = 0

    def name(self, what: str) -> str:
        self.fresh += 1
        return f"__{what}{self.fresh}"

    # nodes and relations
    def nodes(self, var: str) -> DataFrame:
        return self.g.node_rows(*_NODE).select(F.struct(*_NODE).alias(var))

    def node_condition(self, p: NodePattern, c: Column) -> Column:
        out = F.lit(True)
        kinds = [] if p.label is None else [p.label]
        for key, (value, span) in p.props.items():
            if key not in NODE_PROPS:
                raise CqlError("plan", f"nodes have no property {key}", span)
            if key == "kind":
                kinds.append(value)
            elif key == "name":
                out = out & matches(str(value), c["fqn"])
            else:
                out = out & (c[NODE_PROPS[key]] == F.lit(value))
        for k in kinds:
            if k not in NODE_KINDS:
                raise CqlError("plan", f"unknown kind of node {k}", p.span)
        return out & c["kind"].isin(*kinds) if kinds else out

    def relations(self, r: RelPattern) -> tuple[DataFrame, bool]:
        """Admitted edges, and whether the pattern runs along them."""
        kinds: set[str] = set()
        flips = set()
        for t, span in r.types:
            if t not in TYPES:
                raise CqlError("plan", f"unknown relationship type {t}", span)
            kinds |= set(TYPES[t])
            flips.add(t == "MEMBER_OF")
        if len(flips) > 1:
            raise CqlError("plan", "MEMBER_OF runs the other way and can't be mixed with other types", r.span)
        e = self.g.edge_rows("src", "dst", *_EDGE, where=F.col("kind").isin(*(sorted(kinds) or CALL_FAMILY)))
        for key, (value, span) in r.props.items():
            if key == "condition":
                e = e.where(F.col("condition") == F.lit(value))
            elif key == "confidence":
                if value not in CONFIDENCES:
                    raise CqlError("plan", f"unknown confidence {value}", span)
                e = e if value == CONFIDENCES[0] else e.where(F.col("confidence").isin(*CONFIDENCES[CONFIDENCES.index(value) :]))
            else:
                raise CqlError("plan", f"relations can't be constrained by {key}", span)
        return e, r.forward != (flips == {True})

    # clauses
    def run(self, clauses: list) -> Result:
        for c in clauses:
            if isinstance(c, Match):
                for p in c.patterns:
                    self.expand(p)
                if c.where is not None:
                    self.filter(c.where)
            elif isinstance(c, Call):
                self.call(c)
            else:
                columns = self.project(c)
        return Result(self.df, columns)

    def bind(self, var: str, kind: str) -> None:
        if self.types.get(var, kind) != kind:
            raise CqlError("plan", f"{var} is a {self.types[var]} already")
        self.types[var] = kind

    def expand(self, p: Pattern) -> None:
        if p.path and len(p.rels) != 1:
            raise CqlError("plan", "a path variable takes a pattern of one relationship", p.nodes[0].span)
        for n in p.nodes[1:-1]:
            if n.var is None:
                raise CqlError("plan", "nodes inside a chain need a name", n.span)
        for i, r in enumerate(p.rels):
            left, right = p.nodes[i], p.nodes[i + 1]
            a, b = left.var or self.name("n"), right.var or self.name("n")
            self.step(left, a, r, right, b, p.path)

    def step(self, left: NodePattern, a: str, r: RelPattern, right: NodePattern, b: str, path: str | None) -> None:
        known_a, known_b = a in self.types, b in self.types
        if self.df is not None and not known_a and not known_b:
            raise CqlError("plan", "a pattern has to share a variable with what is bound before it", left.span)
        e, along = self.relations(r)
        x, y = (a, b) if along else (b, a)
        px, py = (left, right) if along else (right, left)
        if r.hops is None:
            ev = r.var or self.name("r")
            hop = e.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.struct(*_EDGE).alias(ev))
            hop = self.ends(hop, x, px, y, py, a == b)
            if r.var:
                self.bind(r.var, "edge")
            if path:
                self.bind(path, "path")
                na, nb = F.col(a), F.col(b)
                hop = hop.withColumn(path, F.struct(F.array(na, nb).alias("nodes"), F.array(F.col(ev)).alias("edges")))
            self.join(hop, [v for v in dict.fromkeys((a, b)) if v in self.types], drop=[] if r.var else [ev])
        else:
            self.far(left, a, r, right, b, path, e, along)
        for v in (a, b):
            self.bind(v, "node")

    def ends(self, hop: DataFrame, x: str, px: NodePattern, y: str, py: NodePattern, same: bool) -> DataFrame:
        nx = self.nodes(x).where(self.node_condition(px, F.col(x)))
        if same:
            return hop.where(F.col("__s") == F.col("__d")).join(nx.where(self.node_condition(py, F.col(x))), F.col("__s") == F.col(x)["nid"]).drop("__s", "__d")
        ny = self.nodes(y).where(self.node_condition(py, F.col(y)))
        return hop.join(nx, F.col("__s") == F.col(x)["nid"]).join(ny, F.col("__d") == F.col(y)["nid"]).drop("__s", "__d")

    def join(self, hop: DataFrame, shared: list[str], drop: list[str] = ()) -> None:
        hop = hop.drop(*drop)
        if self.df is None:
            self.df = hop
            return
        keyed = hop
        left = self.df
        on = []
        for v in shared:
            k = self.name("k")
            left = left.withColumn(k, F.col(v)["nid"])
            keyed = keyed.withColumn(k, F.col(v)["nid"]).drop(v)
            on.append(k)
        self.df = left.join(keyed, on).drop(*on)

    def far(self, left: NodePattern, a: str, r: RelPattern, right: NodePattern, b: str, path: str | None, e: DataFrame, along: bool) -> None:
        """A path of variable length from a to b. The walk starts at the side that is bound or named more narrowly."""
        low, high = r.hops
        high = MOST_HOPS if high is None else high
        weight = lambda p, v: 3 if v in self.types else 2 if {"name", "fqn"} & set(p.props) else 1 if p.label or p.props else 0
        swap = weight(right, b) > weight(left, a)
        s, t, ps, pt = (b, a, right, left) if swap else (a, b, left, right)
        starts = self.nodes(s).where(self.node_condition(ps, F.col(s)))
        if s in self.types:
            starts = starts.join(self.df.select(F.col(s)["nid"].alias("__k")).distinct(), F.col(s)["nid"] == F.col("__k"), "left_semi")
        starts = cut(starts)
        goals = self.nodes(t).where(self.node_condition(pt, F.col(t)))
        if t in self.types:
            goals = goals.join(self.df.select(F.col(t)["nid"].alias("__k")).distinct(), F.col(t)["nid"] == F.col("__k"), "left_semi")
        steps = walk.oriented(e, along != swap)
        seeds = starts.select(F.col(s)["nid"].alias("root"), F.col(s)["nid"].alias("node"))
        if path:
            self.bind(path, "path")
            found = walk.paths(steps, seeds, goals.select(F.col(t)["nid"].alias("node")), low, high, trails=True)
            if swap:
                found = found.withColumn("path", F.reverse("path")).withColumn("edges", F.reverse("edges"))
            found = self.detailed(found, path)
        else:
            found = walk.within(steps, seeds, low, high)
            if self.max_rows is not None:
                found = found.orderBy("root", "node").limit(self.max_rows)
        if a == b:
            found = found.where(F.col("root") == F.col("node"))
            hop = found.join(starts, F.col("root") == F.col(s)["nid"]).drop("root", "node")
        else:
            hop = found.join(starts, F.col("root") == F.col(s)["nid"]).join(goals, F.col("node") == F.col(t)["nid"]).drop("root", "node")
        if r.var:
            self.types[r.var] = "null"
        self.join(hop, [v for v in dict.fromkeys((a, b)) if v in self.types])

    def detailed(self, found: DataFrame, path: str) -> DataFrame:
        """found (root, node, path, edges) with the ids of path and edges replaced by what queries ask of them."""
        keyed = cut(found.select("root", "node", F.col("path").alias("__p"), F.col("edges").alias("__e")).distinct())
        n = keyed.select("__p", "__e", F.posexplode("__p").alias("i", "nid")).distinct().join(self.g.node_rows(*_NODE), "nid").groupBy("__p", "__e").agg(F.array_sort(F.collect_list(F.struct("i", F.struct(*_NODE).alias("x")))).alias("__n"))
        e = keyed.select("__p", "__e", F.posexplode("__e").alias("i", "eid")).distinct().join(self.g.edge_rows(*_EDGE), "eid").groupBy("__p", "__e").agg(F.array_sort(F.collect_list(F.struct("i", F.struct(*_EDGE).alias("x")))).alias("__r"))
        full = keyed.join(n, ["__p", "__e"]).join(e, ["__p", "__e"])
        return full.select("root", "node", F.struct(F.transform("__n", lambda z: z["x"]).alias("nodes"), F.transform("__r", lambda z: z["x"]).alias("edges")).alias(path))

    def filter(self, where: tuple) -> None:
        for part in _conjuncts(where):
            negated, inner = (True, part[1]) if part[0] == "not" else (False, part)
            if inner[0] == "exists":
                keys, on = self.existing(inner[1])
                self.df = self.keyed(on).join(keys, [k for k, _ in on], "left_anti" if negated else "left_semi").drop(*[k for k, _ in on])
            else:
                condition = self.truth(self.flagged(part), {})
                self.df = self.df.where(condition)

    def keyed(self, on: list[tuple[str, str]]) -> DataFrame:
        df = self.df
        for k, v in on:
            df = df.withColumn(k, F.col(v)["nid"])
        return df

    def existing(self, p: Pattern) -> tuple[DataFrame, list[tuple[str, str]]]:
        """Keys for which a pattern exists, and the bound variables they stand for."""
        if len(p.rels) != 1:
            raise CqlError("plan", "a pattern predicate takes one relationship", p.nodes[0].span)
        left, right, r = p.nodes[0], p.nodes[1], p.rels[0]
        bound = [n.var for n in p.nodes if n.var in self.types]
        if not bound:
            raise CqlError("plan", "a pattern predicate needs a bound variable", left.span)
        inner = Compiler(self.g)
        inner.fresh = self.fresh + 1000
        a, b = left.var or inner.name("n"), right.var or inner.name("n")
        if r.hops is not None:
            v = bound[0]
            inner.df = self.df.select(F.col(v)).distinct()
            inner.types[v] = "node"
        inner.step(left, a, r, right, b, None)
        on = [(self.name("k"), v) for v in dict.fromkeys(bound)]
        return inner.df.select(*[F.col(v)["nid"].alias(k) for k, v in on]).distinct(), on

    def flagged(self, e: tuple) -> tuple:
        """The expression with each pattern predicate replaced by a column that tells whether it exists."""
        if e[0] == "exists":
            keys, on = self.existing(e[1])
            flag = self.name("f")
            self.df = self.keyed(on).join(keys.withColumn(flag, F.lit(True)), [k for k, _ in on], "left").drop(*[k for k, _ in on])
            return ("column", F.coalesce(F.col(flag), F.lit(False)))
        if e[0] in ("and", "or"):
            return (e[0], self.flagged(e[1]), self.flagged(e[2]))
        if e[0] == "not":
            return ("not", self.flagged(e[1]))
        return e

    def call(self, c: Call) -> None:
        proc = c.proc.rsplit(".", 1)[-1]
        if proc not in ("mutation_fanout", "pedigree"):
            raise CqlError("plan", f"unknown procedure {c.proc}", c.span)
        out = {"mutation_fanout": "mutator", "pedigree": "source"}[proc]
        for col, _ in c.yields:
            if col not in (out, "confidence"):
                raise CqlError("plan", f"{proc} yields {out} and confidence, not {col}", c.span)
        flow = self.g.raw_edges.where(F.col("kind") == "derives-from")
        if c.arg[0] == "literal" and isinstance(c.arg[1], str):
            subject = self.g.find(c.arg[1]).groupBy("graph_id").agg(F.min("nid").alias("root")).select(F.lit(c.arg[1]).alias("__arg"), "root")
        elif self.df is not None:
            arg, kind = self.value(c.arg, {})
            if kind != "str":
                raise CqlError("eval", "the argument has to be a string", c.span)
            names = self.df.select(arg.alias("__arg")).distinct()
            n = self.g.raw_nodes.select("graph_id", "nid", F.col("fqn").alias("__arg"))
            subject = names.join(n, "__arg").groupBy("__arg", "graph_id").agg(F.min("nid").alias("root")).select("__arg", "root")
        else:
            raise CqlError("eval", "the argument has to be a string", c.span)
        subject = cut(subject)
        found = walk.bfs(walk.oriented(flow, proc == "mutation_fanout"), subject.select("root", F.col("root").alias("node")), MOST_HOPS)
        node = self.name("y")
        rows = found.select("root", "node", "confidence").join(subject, "root").join(self.nodes(node), F.col("node") == F.col(node)["nid"])
        rows = rows.select("__arg", *[(F.col(node) if col == out else F.col("confidence")).alias(alias) for col, alias in c.yields])
        for col, alias in c.yields:
            self.bind(alias, "node" if col == out else "str")
        if self.df is None:
            self.df = rows.drop("__arg")
        elif c.arg[0] == "literal":  # the same answer for each row: a join on the argument itself
            self.df = self.df.withColumn("__arg", F.lit(c.arg[1])).join(rows, "__arg").drop("__arg")
        else:
            self.df = self.df.withColumn("__arg", self.value(c.arg, {})[0]).join(rows, "__arg").drop("__arg")
        if c.where is not None:
            self.filter(c.where)

    # projection
    def representative(self) -> Column:
        ids = [F.col(v)["nid"] for v, t in self.types.items() if t == "node" and v in self.df.columns]
        return F.least(*ids) if len(ids) > 1 else ids[0] if ids else F.lit(None).cast("long")

    def project(self, p: Projection) -> list[str]:
        if self.df is None:
            raise CqlError("plan", "there is nothing to project")
        names = [alias for _, alias in p.items]
        if len(set(names)) < len(names):
            raise CqlError("plan", "two columns have one name")
        aggregates = [_aggregate(e) for e, _ in p.items]
        typed: dict[str, str] = {}
        rep = self.representative()
        if any(aggregates):
            keys, aggs = [], []
            for (e, alias), agg in zip(p.items, aggregates):
                if agg:
                    column, typed[alias] = self.aggregate(e, rep)
                    aggs.append(column.alias(alias))
                else:
                    column, typed[alias] = self.value(e, {})
                    keys.append((column, alias))
            marked = self.df.withColumn("__rep", rep)
            x = marked.groupBy(*[c.alias(n) for c, n in keys]).agg(*aggs) if keys else marked.agg(*aggs)
            x = x.select(*[F.col(f"`{n}`") for n in names])
            order: list[Column] = []
        else:
            columns = []
            for e, alias in p.items:
                column, typed[alias] = self.value(e, {})
                columns.append(column.alias(alias))
            x = self.df.select(*columns, rep.alias("__rep"))
            if p.distinct:
                x = x.drop("__rep").distinct()
                order = []
            else:
                order = [F.col("__rep").asc_nulls_last()]
        self.df, self.types = x, typed
        row = [c for n in names for c in self.sortable(n)]
        if p.order:
            order = []
            for e, text, down in p.order:
                name = text if text in names else next((alias for (i, alias) in p.items if i == e), None)
                if name is None:
                    raise CqlError("plan", f"ORDER BY takes a column that is returned, not {text}")
                order += [c.desc_nulls_last() if down else c.asc_nulls_first() for c in self.sortable(name)]
        if p.final or p.limit is not None:
            self.df = self.df.orderBy(*order, *row)
        if p.limit is not None:
            self.df = self.df.limit(p.limit)
        self.df = self.df.drop("__rep")
        if p.where is not None:  # a WITH filters after its limit
            self.filter(p.where)
        return names

    def sortable(self, name: str) -> list[Column]:
        c, t = F.col(f"`{name}`"), self.types[name]
        if t == "node":
            return [c["nid"]]
        if t == "edge":
            return [c["eid"]]
        if t == "path":
            return [F.transform(c["nodes"], lambda z: z["nid"]), F.transform(c["edges"], lambda z: z["eid"])]
        if t == "list:node":
            return [F.transform(c, lambda z: z["nid"])]
        if t == "list:edge":
            return [F.transform(c, lambda z: z["eid"])]
        return [c]

    def aggregate(self, e: tuple, rep: Column) -> tuple[Column, str]:
        _, name, args, span = e
        if len(args) != 1:
            raise CqlError("plan", f"{name} takes one argument", span)
        if args[0] == ("star",):
            if name.lower() != "count":
                raise CqlError("plan", "only count takes *", span)
            return F.count(F.lit(1)), "int"
        c, t = self.value(args[0], {})
        if name.lower() == "count":
            return F.count(c), "int"
        if name.lower() == "collect":
            key = F.struct(F.col("__rep").alias("r"), self.ordered(c, t).alias("k"), c.alias("x"))
            return F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), key))), lambda z: z["x"]), f"list:{t}"
        best = F.max if name.lower() == "max" else F.min
        if t.startswith("list:"):
            inner = t[5:]
            each = F.transform(F.filter(c, lambda z: z.isNotNull()), lambda z: F.struct(self.ordered(z, inner).alias("k"), z.alias("x")))
            pick = F.array_max(each) if name.lower() == "max" else F.array_min(each)
            return best(pick)["x"], inner
        return best(F.when(c.isNotNull(), F.struct(self.ordered(c, t).alias("k"), c.alias("x"))))["x"], t

    @staticmethod
    def ordered(c: Column, t: str) -> Column:
        """What values compare by: nodes and edges by id, confidences by rank (below other strings)."""
        if t == "node":
            return c["nid"]
        if t == "edge":
            return c["eid"]
        if t == "path":
            return F.transform(c["edges"], lambda z: z["eid"])
        if t == "str":
            rank = F.array_position(F.array(*[F.lit(x) for x in CONFIDENCES]), c)
            return F.when(rank > 0, F.concat(F.lit("\x01"), rank.cast("string"))).otherwise(c)
        return c

    # expressions: (column, type) with the types bool int float str null node edge path list:<type>
    def truth(self, e: tuple, scope: dict) -> Column:
        if e[0] == "and":
            return self.truth(e[1], scope) & self.truth(e[2], scope)
        if e[0] == "or":
            return self.truth(e[1], scope) | self.truth(e[2], scope)
        if e[0] == "not":
            return ~self.truth(e[1], scope)
        c, t = self.value(e, scope)
        if t == "bool":
            return F.coalesce(c, F.lit(False))
        return F.lit(False) if t == "null" else c.isNotNull()

    def value(self, e: tuple, scope: dict) -> tuple[Column, str]:
        kind = e[0]
        if kind in ("and", "or", "not"):
            return self.truth(e, scope), "bool"
        if kind == "column":
            return e[1], "bool"
        if kind == "literal":
            return _literal(e[1])
        if kind == "property":
            return self.property(e, scope)
        if kind == "cmp":
            return self.compare(e, scope), "bool"
        if kind == "comprehension":
            _, var, of, only, what = e
            c, t = self.list(of, scope)
            out_type = self.value(what, {**scope, var: (_dummy(t[5:]), t[5:])})[1] if t != "list:null" else "null"
            kept = c if only is None else F.filter(c, lambda z: self.truth(only, {**scope, var: (z, t[5:])}))
            return F.transform(kept, lambda z: self.value(what, {**scope, var: (z, t[5:])})[0]), f"list:{out_type}"
        if kind == "quantifier":
            _, q, var, of, pred = e
            c, t = self.list(of, scope)
            test = lambda z: self.truth(pred, {**scope, var: (z, t[5:])})
            if q == "ALL":
                return F.forall(c, test), "bool"
            found = F.exists(c, test)
            return (found if q == "ANY" else ~found), "bool"
        if kind == "function":
            return self.function(e, scope)
        raise CqlError("plan", f"{kind} can't stand here")

    def list(self, e: tuple, scope: dict) -> tuple[Column, str]:
        c, t = self.value(e, scope)
        if t == "null":
            return F.array().cast("array<string>"), "list:null"
        if not t.startswith("list:"):
            raise CqlError("eval", "a list is needed here")
        return F.coalesce(c, F.array()), t

    def property(self, e: tuple, scope: dict) -> tuple[Column, str]:
        _, head, path, span = e
        if head in scope:
            c, t = scope[head]
        elif head in self.types:
            c, t = (F.lit(None), "null") if self.types[head] == "null" else (F.col(f"`{head}`"), self.types[head])
        else:
            raise CqlError("plan", f"unknown variable {head}", span)
        if not path:
            return c, t
        if len(path) > 1:
            raise CqlError("plan", "nested properties are not supported", span)
        if t == "null":
            return F.lit(None).cast("string"), "str"
        if t == "node":
            if path[0] not in NODE_PROPS:
                raise CqlError("plan", f"nodes have no property {path[0]}", span)
            return c[NODE_PROPS[path[0]]], "int" if path[0] == "line" else "str"
        if t == "edge":
            if path[0] not in EDGE_PROPS:
                raise CqlError("plan", f"relations have no property {path[0]}", span)
            return c[path[0]], "str"
        raise CqlError("plan", f"a {t} has no properties", span)

    def compare(self, e: tuple, scope: dict) -> Column:
        _, op, left, right, span = e
        a, ta = self.value(left, scope)
        b, tb = self.value(right, scope)
        if op == "IN":
            if tb == "null":
                return F.lit(False)
            if not tb.startswith("list:"):
                raise CqlError("eval", "IN takes a list", span)
            if ta == "null":
                return F.coalesce(F.exists(b, lambda z: z.isNull()), F.lit(False))
            if not _alike(ta, tb[5:]):
                return F.lit(False)
            key = self.identity(a, ta)
            hit = F.exists(b, lambda z: F.coalesce(self.identity(z, tb[5:]) == key, F.lit(False)) | (z.isNull() & a.isNull()))
            return F.coalesce(hit, F.lit(False))
        if "null" in (ta, tb):
            return F.lit(False)
        both = a.isNotNull() & b.isNotNull()
        if not _alike(ta, tb):
            if op == "=":
                return F.lit(False)
            if op == "<>":
                return both
            first, second = _rank(ta), _rank(tb)
            return both & F.lit({"<": first < second, "<=": first < second, ">": first > second, ">=": first > second}[op])
        x, y = self.identity(a, ta), self.identity(b, tb)
        out = {"=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()
        return F.coalesce(out, F.lit(False))

    @staticmethod
    def identity(c: Column, t: str) -> Column:
        if t == "node":
            return c["nid"]
        if t == "edge":
            return c["eid"]
        if t == "path":
            return F.transform(c["edges"], lambda z: z["eid"])
        return c

    def function(self, e: tuple, scope: dict) -> tuple[Column, str]:
        _, name, args, span = e
        if _aggregate(e):
            raise CqlError("plan", f"{name} can only stand at the top of a column", span)
        low = name.lower()
        counts = {"nodes": (1, 1), "relationships": (1, 1), "length": (1, 1), "last_node": (1, 1), "position_in": (2, 2), "size": (1, 1), "select": (2, 3)}
        if low not in counts:
            raise CqlError("plan", f"the function {name} is not supported", span)
        if not counts[low][0] <= len(args) <= counts[low][1]:
            raise CqlError("plan", f"{name} has a wrong number of arguments", span)
        if low == "select":
            n, t = self.value(args[0], scope)
            agnostic = len(args) == 3 and args[2] in (("literal", True), ("property", "agnostic", [], args[2][-1]))
            if t == "null":
                return F.lit(False), "bool"
            if t != "node" or args[1][0] != "literal" or not isinstance(args[1][1], str):
                raise CqlError("eval", "select takes a node and a selector", span)
            try:
                return F.coalesce(select(args[1][1], n["fqn"], n["lang"], agnostic), F.lit(False)), "bool"
            except SelectorError as err:
                raise CqlError("eval", str(err), span) from err
        c, t = self.value(args[-1] if low == "position_in" else args[0], scope)
        if low == "size":
            if t == "null":
                return F.lit(None).cast("int"), "int"
            if not t.startswith("list:"):
                raise CqlError("eval", "size takes a list", span)
            return F.when(c.isNotNull(), F.size(c)), "int"
        if t != "path":
            raise CqlError("eval", f"{name} takes a path", span)
        if low == "nodes":
            return c["nodes"], "list:node"
        if low == "relationships":
            return c["edges"], "list:edge"
        if low == "length":
            return F.size(c["edges"]), "int"
        if low == "last_node":
            return F.try_element_at(c["nodes"], F.lit(-1)), "node"
        n, tn = self.value(args[0], scope)
        if tn != "node":
            raise CqlError("eval", "position_in takes a node", span)
        at = F.array_position(F.transform(c["nodes"], lambda z: z["nid"]), n["nid"])
        return F.when(at > 0, (at - 1).cast("int")), "int"


def _conjuncts(e: tuple) -> list[tuple]:
    return [*_conjuncts(e[1]), *_conjuncts(e[2])] if e[0] == "and" else [e]


def _aggregate(e: tuple) -> bool:
    return e[0] == "function" and e[1].lower() in ("count", "collect", "min", "max")


def _alike(a: str, b: str) -> bool:
    number = ("int", "float")
    return a == b or (a in number and b in number) or "list:null" in (a, b) and a.startswith("list:") and b.startswith("list:")


def _rank(t: str) -> int:
    return 5 if t.startswith("list:") else {"bool": 1, "int": 2, "float": 2, "str": 4, "node": 6, "edge": 7, "path": 8}[t]


def _dummy(t: str) -> Column:
    return {"node": F.struct(*[F.lit("").alias(c) for c in _NODE]), "edge": F.struct(*[F.lit("").alias(c) for c in _EDGE])}.get(t, F.lit(None))


def _literal(v: object) -> tuple[Column, str]:
    if v is None:
        return F.lit(None), "null"
    if isinstance(v, bool):
        return F.lit(v), "bool"
    if isinstance(v, int):
        return F.lit(v), "int"
    if isinstance(v, float):
        return F.lit(v), "float"
    if isinstance(v, str):
        return F.lit(v), "str"
    kinds = {_literal(x)[1] for x in v} - {"null"}
    if len(kinds) > 1 and kinds != {"int", "float"}:
        raise CqlError("plan", "a list holds values of one type")
    kind = "float" if len(kinds) == 2 else next(iter(kinds), "null")
    sql = {"bool": "boolean", "int": "bigint", "float": "double"}.get(kind, "string")
    return F.array(*[F.lit(x) for x in v]).cast(f"array<{sql}>"), f"list:{kind}"


def run(graph: CodeGraph, text: str, max_rows: int | None = None) -> DataFrame:
    """The answer of a query as a DataFrame; nodes, relations and paths stay structs. max_rows caps paths without a path variable, by default nothing does."""
    return Compiler(graph, max_rows).run(parse(text)).rows


def plain(rows: DataFrame) -> DataFrame:
    """Nodes by name, relations by id, paths by the names along them, lists joined by commas."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        if kind.startswith("struct<nid"):
            c = c["fqn"]
        elif kind.startswith("struct<eid"):
            c = c["eid"]
        elif kind.startswith("struct<nodes"):
            c = F.array_join(F.transform(c["nodes"], lambda n: n["fqn"]), " > ")
        elif kind.startswith("array<struct<nid"):
            c = F.array_join(F.transform(c, lambda n: n["fqn"]), ",")
        elif kind.startswith("array<struct<eid"):
            c = F.array_join(F.transform(c, lambda n: n["eid"].cast("string")), ",")
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return rows.select(*out)
