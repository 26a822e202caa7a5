"""Ordered-group operators: does the order of rows in each group follow a model, and if not, why.

Groups are gathered as arrays of small class ids, in chunks of at most about `chunk_rows` rows. A
chunk is summarised as a map from entry state to end state, in runs of states; summaries of one group
compose, so a group of any size is decided from a few small arrays and no task holds more than a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.functions.model import Model
from plumbline.functions.repairs import Repairer
from plumbline.functions.stepping import inside, preimage, value
from plumbline.operators.findings import finding, key_text
from plumbline.plans.ordered import CHUNK, match, row_numbers, with_chunks
from plumbline.plans.skew import skew_join

OP = "struct<kind:string,index:long,name:string,existing:string>"


@dataclass
class Groups:
    """Rows of a table as ordered groups of symbols."""

    df: DataFrame
    keys: Sequence[str]
    order: str
    symbol: str
    model: Model
    chunk_rows: int | None = None

    def __post_init__(self):
        self.keys = list(self.keys)
        chunked, self.cut = with_chunks(self.df, self.keys, self.order, self.chunk_rows)
        row = F.struct(F.col(self.order).alias("o"), self.model.class_of(F.col(self.symbol)).alias("c"), F.col(self.symbol).alias("s"))
        rows = chunked.groupBy(*self.keys, CHUNK).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
        self.chunks = rows.select(*self.keys, CHUNK, F.col("_rows.o").alias("_ords"), F.col("_rows.c").alias("_cls"),
                                  F.col("_rows.s").alias("_syms"))

    # --- summaries -------------------------------------------------------------------------------

    def _maps(self) -> DataFrame:
        """Per group its chunks in order: the map from entry to exit state as runs, rows and classes of each."""
        steps = self.model.steps

        @F.pandas_udf(MAP)
        def summary(cls: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([[a.tolist() for a in steps.chunk_map(c)] for c in cls], columns=["start", "target", "slope"])

        part = self.chunks.select(*self.keys, CHUNK, summary("_cls").alias("m"), F.size("_cls").alias("n"),
                                  F.array_distinct("_cls").alias("seen"))
        return part.groupBy(*self.keys).agg(
            F.array_sort(F.collect_list(F.struct(F.col(CHUNK).alias("chunk"), "m", "n", "seen"))).alias("_parts"))

    def final_states(self) -> DataFrame:
        """(keys, state) after the last row of each group."""
        if not self.cut:
            return self.chunks.select(*self.keys, self._fold(F.col("_cls")).alias("state"))

        @F.pandas_udf("int")
        def through(parts: pd.Series) -> pd.Series:
            out = []
            for group in parts:
                state = 0
                for p in group:
                    state = value(_map(p["m"]), state)
                out.append(state)
            return pd.Series(out)

        return self._maps().select(*self.keys, through("_parts").alias("state"))

    def _fold(self, cls: Column, entry: Column | None = None) -> Column:
        """State after the rows: inside the plan for a small model, in Arrow batches for one with many states."""
        entry = F.lit(0) if entry is None else entry
        if self.model.small:
            return F.aggregate(cls, entry, self.model.step)
        steps = self.model.steps

        @F.pandas_udf("int")
        def final(cls: pd.Series, entry: pd.Series) -> pd.Series:
            return pd.Series([t[-1] if len(t) else e for t, e in zip(steps.traces(list(cls), list(entry)), entry)])

        return final(cls, entry)

    def per_state(self, state: Column, kind: str, of) -> Column:
        """A function of the model state: a list in the plan for a small model, computed in Arrow batches otherwise."""
        if self.model.small:
            return F.get(F.array(*[F.lit(None).cast(kind) if (v := of(s)) is None else (F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)).cast(kind)
                                   for s in range(self.model.size)]), state)

        @F.pandas_udf(kind)
        def looked_up(state: pd.Series) -> pd.Series:
            known = {s: of(s) for s in set(state.dropna().tolist())}
            return pd.Series([known.get(s) for s in state], dtype=object)

        return looked_up(state)

    def bounded_chunks(self) -> DataFrame:
        """Chunks with what they need to know of the rest of their group: the entry state, the
        states that the rows after the chunk can complete (ranges), rows before it, the final state, the
        classes present, and whether it is the last chunk."""
        model = self.model
        flat = lambda ranges: [x for r in ranges for x in r]
        if not self.cut:
            return self.chunks.withColumns({
                "_entry": F.lit(0), "_alive": F.array(*map(F.lit, flat(model.live))).cast("array<int>"), "_before": F.lit(0).cast("long"),
                "_final": self._fold(F.col("_cls")), "_seen": F.array_distinct("_cls"), "_last": F.lit(True)})

        @F.pandas_udf("array<struct<entry:int,alive:array<int>,before:long,final:int,last:boolean>>")
        def bounds(parts: pd.Series) -> pd.Series:
            out = []
            for group in parts:
                maps = [_map(p["m"]) for p in group]
                entries, state = [], 0
                for m in maps:
                    entries.append(state)
                    state = value(m, state)
                alive = model.live
                after = []
                for m in reversed(maps):
                    after.append(flat(alive))
                    alive = preimage(m, alive, model.size)
                after.reverse()
                befores = np.concatenate([[0], np.cumsum([p["n"] for p in group])])
                out.append([{"entry": e, "alive": a, "before": int(b), "final": state, "last": i == len(maps) - 1}
                            for i, (e, a, b) in enumerate(zip(entries, after, befores))])
            return pd.Series(out)

        known = self._maps().withColumn("_b", bounds("_parts")).withColumn(
            "_seen", F.array_distinct(F.flatten(F.col("_parts.seen"))))
        known = known.select(*self.keys, "_seen", F.explode(F.arrays_zip(F.col("_parts.chunk").alias("chunk"), F.col("_b").alias("b"))).alias("_z"))
        known = known.select(*self.keys, F.col("_z.chunk").alias(CHUNK), F.col("_z.b.entry").alias("_entry"), F.col("_z.b.alive").alias("_alive"),
                             F.col("_z.b.before").alias("_before"), F.col("_z.b.final").alias("_final"), "_seen", F.col("_z.b.last").alias("_last"))
        return match(self.chunks, known, [*self.keys, CHUNK])


MAP = "struct<start:array<long>,target:array<long>,slope:array<long>>"


def _map(m) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.asarray(m[c], np.int64) for c in ("start", "target", "slope"))


def _ranges(flat) -> tuple[tuple[int, int], ...]:
    flat = list(map(int, flat))
    return tuple(zip(flat[::2], flat[1::2]))


def sequence_valid(g: Groups) -> DataFrame:
    """Does each group match the model exactly?"""
    return g.final_states().select(*g.keys, g.model.is_accepting(F.col("state")).alias("valid"))


def sequence_trace(g: Groups) -> DataFrame:
    """Model state after each row (the dead state is the last one)."""
    steps = g.model.steps

    @F.pandas_udf("array<int>")
    def states(cls: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([t.tolist() for t in steps.traces(list(cls), list(entry))])

    out = g.bounded_chunks().withColumn("_s", states("_cls", "_entry"))
    out = out.select(*g.keys, F.explode(F.arrays_zip("_ords", "_syms", "_s")).alias("_r"))
    return out.select(*g.keys, F.col("_r._ords").alias(g.order), F.col("_r._syms").alias(g.symbol), F.col("_r._s").alias("state"))


def first_invalid(g: Groups) -> DataFrame:
    """Order value of the row at which the group first breaks; NULL for one merely incomplete."""
    dead = g.model.dead
    start = lambda entry: F.struct(entry.alias("s"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad"))
    def move(a: Column, c: Column) -> Column:
        nxt = g.model.step(a["s"], c)
        return F.struct(nxt.alias("s"), (a["i"] + 1).alias("i"),
                        F.coalesce(a["bad"], F.when(nxt == dead, a["i"])).alias("bad"))
    chunks = g.bounded_chunks() if g.cut else g.chunks.withColumn("_entry", F.lit(0))
    steps = g.model.steps

    @F.pandas_udf("int")
    def breaks(cls: pd.Series, entry: pd.Series) -> pd.Series:
        traces = steps.traces(list(cls), list(entry))
        return pd.Series([int(np.argmax(t == dead)) if len(t) and t[-1] == dead else None for t in traces], dtype="Int32")  # no way back from the dead state

    at = F.aggregate("_cls", start(F.col("_entry")), move)["bad"] if g.model.small else breaks("_cls", "_entry")
    found = chunks.withColumn("_bad", F.when(F.col("_entry") != dead, F.get("_ords", at)))
    if not g.cut:
        return found.select(*g.keys, F.col("_bad").alias("first_invalid"))
    return found.groupBy(*g.keys).agg(F.min("_bad").alias("first_invalid"))


def missing_to_complete(g: Groups) -> DataFrame:
    """Shortest named continuation of each group; NULL where it is already broken."""
    model = g.model
    if not model.small:
        return g.final_states().select(*g.keys, g.per_state(F.col("state"), "array<string>", model.shortest).alias("missing"))
    first = [next(model.walk_out(s), None) for s in range(model.size)]
    left = F.array(*[F.lit(model.to_go(s)).cast("int") for s in range(model.size)])
    symbol = F.array(*[F.lit(None if c is None else model.names[c]).cast("string") for c in first])
    behind = F.array(*[F.lit(None if c is None else model.delta[s][c]).cast("int") for s, c in enumerate(first)])
    start = F.struct(F.col("state").cast("int").alias("at"), F.array().cast("array<string>").alias("path"))
    path = F.aggregate(F.sequence(F.lit(1), F.get(left, F.col("state"))), start,
                       lambda done, _: F.struct(F.get(behind, done["at"]).alias("at"), F.concat(done["path"], F.array(F.get(symbol, done["at"]))).alias("path")),
                       lambda done: done["path"])
    n = F.get(left, F.col("state"))
    return g.final_states().select(*g.keys, F.when(n == 0, F.array().cast("array<string>")).when(n > 0, path).alias("missing"))


def allowed_next(g: Groups) -> DataFrame:
    """Symbols legal after the last row that can still lead to a complete group."""
    return g.final_states().select(*g.keys, g.per_state(F.col("state"), "array<string>", g.model.next_names).alias("allowed"))


def _offers(model: Model, cls: Sequence[int], states: Sequence[int], alive) -> Iterator[list[int]]:
    """For every state before a row, and the one after the last, the classes that may be inserted there."""
    steps, dead, known = model.steps, model.dead, {}
    for state, after in zip(states, steps.alive_before(list(cls), _ranges(alive))):
        if (state, after) not in known:
            known[state, after] = [c for c in model.options(state) if (to := steps.one(state, c)) != dead and inside(after, to)]
        yield known[state, after]


def allowed_at_gaps(g: Groups) -> DataFrame:
    """Symbols that may be inserted at every gap so that what follows still fits."""
    model = g.model

    @F.pandas_udf("array<array<string>>")
    def gaps(cls: pd.Series, entry: pd.Series, alive: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for c, e, t, a, end in zip(cls, entry, model.steps.traces(list(cls), list(entry)), alive, last):
            states = [int(e), *t.tolist()]
            out.append([[model.names[x] for x in here] for here in _offers(model, c, states if end else states[:-1], a)])
        return pd.Series(out)

    found = g.bounded_chunks().withColumn("_g", gaps("_cls", "_entry", "_alive", "_last"))
    out = found.select(*g.keys, "_before", "_ords", F.posexplode("_g").alias("_i", "allowed"))
    return out.select(*g.keys, (F.col("_before") + F.col("_i")).alias("gap"), F.get("_ords", F.col("_i")).alias("before_row"), "allowed")


def insertion_plan(g: Groups) -> DataFrame:
    """Every symbol that can be inserted somewhere, once, at its earliest gap, with a label:
    required-missing, suggested (first optional of a gap without required ones), optional, repeat."""
    model = g.model

    @F.pandas_udf("array<struct<gap:long,cls:int,label:string>>")
    def plan(cls: pd.Series, entry: pd.Series, alive: pd.Series, before: pd.Series, final: pd.Series,
             seen: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for c, e, t, a, b, f, present, end in zip(cls, entry, model.steps.traces(list(cls), list(entry)), alive, before, final, seen, last):
            states = [int(e), *t.tolist()]
            required, present = set(model.walk_out(f)), set(present)
            got = {}
            for i, here in enumerate(_offers(model, c, states if end else states[:-1], a)):
                labels = ["required-missing" if x in required else "repeat" if x in present else "optional" for x in here]
                if "required-missing" not in labels and "optional" in labels:
                    labels[labels.index("optional")] = "suggested"
                for x, label in zip(here, labels):
                    got.setdefault(x, {"gap": int(b) + i, "cls": x, "label": label})
                if len(got) == len(model.names) - 1:
                    break
            out.append(list(got.values()))
        return pd.Series(out)

    found = g.bounded_chunks().withColumn("_p", plan("_cls", "_entry", "_alive", "_before", "_final", "_seen", "_last"))
    each = found.select(*g.keys, F.explode("_p").alias("_x"))
    best = each.groupBy(*g.keys, F.col("_x.cls").alias("_c")).agg(F.min(F.struct("_x.gap", "_x.label")).alias("_m"))
    label = F.col("_m.label")
    rank = F.when(label == "required-missing", 0).when(label == "suggested", 1).when(label == "optional", 2).otherwise(3)
    # at most one row per model symbol in each group
    place = F.row_number().over(W.partitionBy(*g.keys).orderBy(rank, F.col("_m.gap"), F.col("_c")))
    return best.select(*g.keys, place.alias("place"), F.get(F.array(*map(F.lit, model.names)), F.col("_c")).alias("name"),
                       F.col("_m.gap").alias("gap"), label.alias("label"))


# --- repair --------------------------------------------------------------------------------------

def _shape_plans(g: Groups, max_edits: int) -> DataFrame:
    """(keys, cost, edits) of the failing groups; cost NULL where no short repair exists.

    Uncut groups: the search runs once per distinct failing shape. Cut groups: a cost table per
    chunk, the cheapest way through them per group, then edits only inside chunks that need any.
    """
    model = g.model
    fixer = Repairer(model, max_edits)
    edit_type = "array<struct<kind:string,index:long,name:string>>"

    def as_rows(ops, offset=0):
        return [{"kind": k, "index": int(i) + offset, "name": n} for k, i, n, _ in ops]

    if not g.cut:
        @F.pandas_udf(f"struct<cost:int,edits:{edit_type}>")
        def solve(cls: pd.Series) -> pd.DataFrame:
            found = [fixer.repair(list(c)) for c in cls]
            return pd.DataFrame([(None, None) if x is None else (x[0], as_rows(x[1])) for x in found], columns=["cost", "edits"])

        failing = g.chunks.where(~model.is_accepting(g._fold(F.col("_cls")))).withColumn("_h", F.xxhash64("_cls"))
        shapes = failing.select("_h", F.col("_cls").alias("_shape")).distinct().withColumn("_plan", solve("_shape"))
        out = skew_join(failing, shapes, ["_h"]).where(F.col("_cls") == F.col("_shape"))  # joined by the hash, kept where the rows are equal
        out = out.select(*g.keys, F.col("_plan.cost").alias("cost"), F.col("_plan.edits").alias("_edits"), "_syms", "_ords")
        return out.withColumn("edits", F.transform("_edits", lambda e: F.struct(
            e["kind"].alias("kind"), e["index"].alias("index"),
            F.when(e["kind"] == "transpose", F.get("_syms", (e["index"] + 1).cast("int"))).otherwise(e["name"]).alias("name"),
            F.when(e["kind"] != "insert", F.get("_syms", e["index"].cast("int"))).alias("existing"),
            F.get("_ords", e["index"].cast("int")).alias("at")))).select(*g.keys, "cost", "edits")

    broken = g.final_states().where(~model.is_accepting(F.col("state"))).select(*g.keys)
    chunks = match(g.bounded_chunks(), broken, g.keys, "left_semi")
    tail = F.lag(F.element_at("_cls", -1)).over(W.partitionBy(*g.keys).orderBy(CHUNK))
    ends = chunks.select(*g.keys, CHUNK, F.coalesce(tail, F.lit(-1)).alias("_prev"))
    chunks = match(chunks, ends, [*g.keys, CHUNK])

    @F.pandas_udf("array<struct<low:long,high:long,moving:boolean,value:long,cost:long>>")
    def table(cls: pd.Series, prev: pd.Series) -> pd.Series:
        columns = ("low", "high", "moving", "value", "cost")
        return pd.Series([[dict(zip(columns, way)) for way in fixer.table(list(c), int(p))] for c, p in zip(cls, prev)])

    @F.pandas_udf("struct<cost:int,states:array<long>>")
    def route(parts: pd.Series) -> pd.DataFrame:
        rows = []
        for group in parts:
            way = fixer.path([[(x["low"], x["high"], x["moving"], x["value"], x["cost"]) for x in p["m"]] for p in group])
            rows.append((None, None) if way is None else (way[1], way[0]))
        return pd.DataFrame(rows, columns=["cost", "states"])

    @F.pandas_udf(edit_type)
    def edits(cls: pd.Series, entry: pd.Series, leave: pd.Series, prev: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([as_rows(fixer.plan(list(c), int(e), int(x), int(p)), int(b))
                          for c, e, x, p, b in zip(cls, entry, leave, prev, before)])

    parts = (chunks.select(*g.keys, CHUNK, table("_cls", "_prev").alias("m")).groupBy(*g.keys)
             .agg(F.array_sort(F.collect_list(F.struct(F.col(CHUNK).alias("chunk"), "m"))).alias("_parts")))
    routes = parts.withColumn("_r", route("_parts")).select(*g.keys, F.col("_parts.chunk").alias("_chunks"), F.col("_r.cost").alias("cost"), F.col("_r.states").alias("_st"))
    steps = routes.where("cost is not null").select(*g.keys, F.posexplode("_chunks").alias("_i", CHUNK), "_st").select(
        *g.keys, CHUNK, F.get("_st", F.col("_i")).alias("_in"), F.get("_st", F.col("_i") + 1).alias("_out"))
    # a chunk whose own map leads from entry to exit needs no edit
    work = match(chunks, steps, [*g.keys, CHUNK])
    entry = F.least(F.col("_in"), F.lit(model.dead)).cast("int")
    plain = (F.col("_in") < model.size) & (g._fold(F.col("_cls"), entry) == F.col("_out"))
    work = work.where(~plain).withColumn("_e", edits("_cls", "_in", "_out", "_prev", "_before"))
    local = lambda e: (e["index"] - F.col("_before")).cast("int")
    named = F.transform("_e", lambda e: F.struct(
        e["kind"].alias("kind"), e["index"].alias("index"), e["name"].alias("name"),
        F.when(e["kind"] != "insert", F.get("_syms", local(e))).alias("existing"), F.get("_ords", local(e)).alias("at"),
        F.get("_syms", local(e) + 1).alias("_next")))
    work = work.select(*g.keys, CHUNK, named.alias("_e"), F.get("_syms", F.lit(0)).alias("_head"), F.get("_ords", F.lit(0)).alias("_head_at"))
    # the partner of a straddling swap is the first row of the next chunk, the anchor of a trailing insert too
    heads = g.chunks.select(*g.keys, CHUNK, F.get("_syms", F.lit(0)).alias("_h"), F.get("_ords", F.lit(0)).alias("_hat"))
    nxt = heads.select(*g.keys, CHUNK, F.lead("_h").over(W.partitionBy(*g.keys).orderBy(CHUNK)).alias("_nh"),
                       F.lead("_hat").over(W.partitionBy(*g.keys).orderBy(CHUNK)).alias("_nat"))
    work = match(work, nxt, [*g.keys, CHUNK])
    final = F.transform("_e", lambda e: F.struct(
        e["kind"].alias("kind"), e["index"].alias("index"),
        F.when(e["kind"] == "transpose", F.coalesce(e["_next"], F.col("_nh"))).otherwise(e["name"]).alias("name"),
        e["existing"].alias("existing"), F.coalesce(e["at"], F.col("_nat")).alias("at")))
    listed = (work.select(*g.keys, CHUNK, final.alias("_e")).groupBy(*g.keys)
              .agg(F.flatten(F.array_sort(F.collect_list(F.struct(F.col(CHUNK).alias("chunk"), "_e")))["_e"]).alias("edits")))
    return match(routes.select(*g.keys, "cost"), listed, g.keys, "left")


def repair_plan(g: Groups, max_edits: int = 4) -> DataFrame:
    """(keys, cost, edits) for groups that break the model. Edits are insert, delete, replace and
    transpose, with the original position; cost is NULL where more than `max_edits` are needed."""
    return _shape_plans(g, max_edits)


def repair_cost(g: Groups, max_edits: int = 4) -> DataFrame:
    """Least number of edits per group: 0 where it conforms, NULL beyond the limit."""
    good = sequence_valid(g).where("valid").select(*g.keys, F.lit(0).alias("cost"))
    return good.unionByName(_shape_plans(g, max_edits).select(*g.keys, "cost"))


def apply_repair(symbols: Column, edits: Column) -> Column:
    """Edits applied left to right, with the offset that earlier ones cause."""
    def put(a: Column, at: Column, middle: Column, skip: int) -> Column:
        return F.concat(F.slice(a, 1, at), middle, F.slice(a, at + 1 + skip, F.greatest(F.size(a) - at - skip, F.lit(0))))
    def one(acc: Column, e: Column) -> Column:
        a, at = acc["a"], (e["index"] + acc["o"]).cast("int")
        out = (F.when(e["kind"] == "insert", put(a, at, F.array(e["name"]), 0))
               .when(e["kind"] == "delete", put(a, at, F.array().cast("array<string>"), 1))
               .when(e["kind"] == "replace", put(a, at, F.array(e["name"]), 1))
               .otherwise(put(a, at, F.array(F.get(a, at + 1), F.get(a, at)), 2)))
        move = F.when(e["kind"] == "insert", 1).when(e["kind"] == "delete", -1).otherwise(0)
        return F.struct(out.alias("a"), (acc["o"] + move).alias("o"))
    return F.aggregate(edits, F.struct(symbols.alias("a"), F.lit(0).alias("o")), one)["a"]


def edit_text(kind: Column, name: Column, existing: Column) -> Column:
    said = {"insert": ("Missing here: ", name), "delete": ("Does not belong here: ", existing),
            "replace": ("Expected ", name, " in place of ", existing), "swap": ("Out of order: ", name, " comes before ", existing)}
    text = {k: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]) for k, parts in said.items()}
    return F.when(kind == "insert", text["insert"]).when(kind == "delete", text["delete"]).when(kind == "replace", text["replace"]).otherwise(text["swap"])


def sequence_findings(g: Groups, max_edits: int = 4) -> DataFrame:
    """One finding per edit, at the row or the gap it concerns; groups beyond repair get one."""
    plans = _shape_plans(g, max_edits)
    each = plans.select(*g.keys, "cost", F.explode("edits").alias("_e"))
    kind, text = F.col("_e.kind"), edit_text(F.col("_e.kind"), F.col("_e.name"), F.col("_e.existing"))
    code = (F.when(kind == "insert", "cvc-complex-type.2.4.b").when(kind == "delete", "cvc-complex-type.2.4.d")
            .otherwise("cvc-complex-type.2.4.a"))
    fix = F.array(F.struct(text.alias("title"), F.col("_e.name").alias("value"), F.lit(False).alias("speculative")))
    known = each.select(*finding(
        source="schema", severity="error", code=code, doc_key=key_text(*g.keys), row_key=F.col("_e.at").cast("string"),
        ordinal=F.col("_e.index"), anchor=F.when(kind == "insert", "childGap").otherwise("element"), column=g.symbol,
        message=text, fixes=fix))
    beyond = plans.where("cost is null").select(*finding(
        source="schema", severity="error", code="cvc-complex-type.2.4.a", doc_key=key_text(*g.keys), anchor="element",
        column=g.symbol, message=f"the order cannot be repaired with {max_edits} edits"))
    return known.unionByName(beyond)


def placement_options(g: Groups, fragment: Sequence[str]) -> DataFrame:
    """Errors each group would have with `fragment` appended: none if it then matches; else the
    number of fragment symbols with no place there, at least one."""
    m = g.model
    ids = {n: i for i, n in enumerate(m.names)}

    def errors(state: int) -> int:
        fits, at = set(m.next_names(state)), state
        for x in fragment:
            at = m.steps.one(at, ids.get(x, m.width - 1))
        return 0 if inside(m.accepts, at) else max(1, sum(x not in fits for x in fragment))

    return g.final_states().select(*g.keys, g.per_state(F.col("state"), "int", errors).alias("errors"))


def rank_placements(options: DataFrame, scope: Sequence[str], proximity: str) -> DataFrame:
    """Rank candidate parents inside a scope: fewest errors first, then nearest."""
    keyed = options.withColumn("_score", F.col("errors").cast("long") * F.lit(1 << 40) + F.col(proximity).cast("long"))
    return row_numbers(keyed, scope, "_score", "rank").drop("_score")


def fill_missing_children(g: Groups, values: dict[str, Column]) -> DataFrame:
    """Original rows plus the rows that complete each incomplete group, at its end.

    `values` gives placeholder columns for new rows (may use `symbol` and `_i`, its 1-based place
    among the new rows); the order column continues from the last one. New rows carry added = true.
    """
    need = missing_to_complete(g).where(F.size("missing") > 0)
    last = g.df.groupBy(*g.keys).agg(F.max(g.order).alias("_max"))
    new = match(need, last, g.keys).select(*g.keys, "_max", F.posexplode("missing").alias("_p", "symbol"))
    new = new.withColumn("_i", F.col("_p") + 1)
    types = {f.name: f.dataType for f in g.df.schema.fields}
    cols = []
    for c in g.df.columns:
        if c in g.keys:
            cols.append(F.col(c))
        elif c == g.order:
            cols.append((F.col("_max") + F.col("_i")).cast(types[c]).alias(c))
        elif c == g.symbol:
            cols.append(F.col("symbol").alias(c))
        else:
            cols.append(values.get(c, F.lit(None)).cast(types[c]).alias(c))
    return g.df.withColumn("added", F.lit(False)).unionByName(new.select(*cols, F.lit(True).alias("added")))
