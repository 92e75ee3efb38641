"""Component facts from the token relation: state, effects, setter calls, props and where they are handed on.

A component is a function whose name begins with a capital. Places belong to the
innermost component around them; uses meet definitions by joins on (file,
component, name), so a name of another component is never taken for this one's.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.sources.tokens import STATE, Source, enclosing

#: Hooks that run effects.
EFFECTS = ("useEffect", "useLayoutEffect", "useInsertionEffect")
_NAME = r"[A-Za-z_$][\w$]*"


class Hooks:
    """Relations of one source; each is written once, when it is first asked for."""

    def __init__(self, source: Source) -> None:
        self.source = source

    @cached_property
    def components(self) -> DataFrame:
        """(path, component, c_open, c_close, params): ``component`` is the name and the place of its brace."""
        named = self.source.scopes.where(F.col("kind").isin("function", "arrow") & F.col("name").rlike("^[A-Z]"))
        return self.source.saved(named.select("path", F.concat_ws("@", "name", "open").alias("component"), "name", F.col("open").alias("c_open"), F.col("close").alias("c_close"), "params", "line"), "components")

    def owned(self, places: DataFrame) -> DataFrame:
        """``places`` (path, idx, ...) in a component, with the innermost one."""
        around = self.components.select("path", "component", F.col("c_open").alias("open"), F.col("c_close").alias("close"))
        inner = enclosing(places.select("path", "idx").distinct(), around).groupBy("path", "idx").agg(F.max_by("component", "open").alias("component"))
        return places.join(inner, ["path", "idx"])

    @cached_property
    def states(self) -> DataFrame:
        """(path, component, state, setter) of ``const [state, setter] = useState(...)``, with a namespace or type argument or without."""
        plain = (F.col("p1") == "=") & (F.col("p2") == "]")
        spaced = (F.col("p1") == ".") & (F.col("p3") == "=") & (F.col("p4") == "]")
        near = self.source.fact("marks")
        calls = near.where(F.col("text").isin(*STATE) & (plain | spaced)).select("path", "idx", F.when(plain, F.col("p2_idx")).otherwise(F.col("p4_idx")).alias("close"))
        arrays = near.where("text = '[' AND close IS NOT NULL").select("path", F.col("idx").alias("open"), "close").join(calls, ["path", "close"])
        parts = self.source.arguments(arrays).where("single = 'name'").groupBy("path", "open").agg(F.max(F.when(F.col("arg") == 0, F.col("text"))).alias("state"), F.max(F.when(F.col("arg") == 1, F.col("text"))).alias("setter"))
        return self.source.saved(self.owned(arrays.select("path", "idx", "open")).join(parts, ["path", "open"]).where("state IS NOT NULL").select("path", "component", F.trim("state").alias("state"), F.trim("setter").alias("setter")), "states")

    @cached_property
    def effects(self) -> DataFrame:
        """(path, component, effect, e_open, e_close, line): calls of effect hooks; ``effect`` is the place of the parentheses."""
        calls = self.source.fact("marks").where((F.col("text") == "(") & F.col("p1").isin(*EFFECTS) & F.col("close").isNotNull()).select("path", "idx", "line", "close")
        return self.source.saved(self.owned(calls).select("path", "component", F.col("idx").alias("effect"), F.col("idx").alias("e_open"), F.col("close").alias("e_close"), "line"), "effects")

    def sets(self) -> DataFrame:
        """(path, component, effect, state): states whose setter an effect calls."""
        setters = self.states.where("setter IS NOT NULL").select("path", "component", F.col("setter").alias("text"), "state")
        calls = self.source.fact("marks").where("text = '(' AND p1_kind = 'name' AND coalesce(p2, '') NOT IN ('.', '?.', 'function')").select("path", F.col("p1_idx").alias("idx"), F.col("p1").alias("text"))
        # only names that are a setter somewhere in the file are placed in components
        calls = calls.join(setters.select("path", "text").distinct(), ["path", "text"], "left_semi")
        calls = self.owned(calls).join(setters, ["path", "component", "text"]).select("path", "idx", "component", "state")
        around = self.effects.select("path", F.col("component").alias("of"), "effect", F.col("e_open").alias("open"), F.col("e_close").alias("close"))
        return self.source.saved(enclosing(calls, around).where("component = of").select("path", "component", "effect", "state").distinct(), "sets")

    def deps(self) -> DataFrame:
        """(path, component, effect, state): states in an effect's list of dependencies."""
        args = self.source.arguments(self.effects.select("path", F.col("e_open").alias("open"))).where("arg = 1 AND startswith(text, '[')")
        lists = args.select("path", F.col("open").alias("effect"), F.col("head").alias("open"))
        named = self.source.arguments(lists).where("single = 'name'").join(lists, ["path", "open"]).select("path", "effect", F.trim("text").alias("state"))
        return self.source.saved(named.join(self.effects.select("path", "component", "effect"), ["path", "effect"]).join(self.states.select("path", "component", "state"), ["path", "component", "state"]).distinct(), "deps")

    @cached_property
    def props(self) -> DataFrame:
        """(path, component, prop): names that a component's first parameter takes apart."""
        heads = self.components.where("params IS NOT NULL").select("path", "component", F.col("params").alias("open"))
        first = self.source.arguments(heads).where("arg = 0 AND startswith(text, '{')").join(heads, ["path", "open"]).select("path", "component", F.col("head").alias("open"))
        spec = rf"^({_NAME})(?:\s*:\s*({_NAME}))?(?:\s*=.*)?$"
        listed = self.source.arguments(first).join(first, ["path", "open"]).where(F.trim("text").rlike(f"(?s){spec}"))
        part = lambda i: F.regexp_extract(F.trim("text"), f"(?s){spec}", i)
        return self.source.saved(listed.select("path", "component", F.coalesce(F.nullif(part(2), F.lit("")), part(1)).alias("prop")).distinct(), "props")

    def tagged(self) -> DataFrame:
        """Siblings with ``tag``, the element whose attributes they stand among, null elsewhere."""
        beside = Window.partitionBy("path", "parent").orderBy("idx")
        opened = F.last(F.when((F.col("p1") == "<") & F.col("text").rlike(_NAME), F.col("text")).when(F.col("text") == ">", ">"), True).over(beside)
        return self.source.rows.withColumns({"tag": F.nullif(opened, F.lit(">")), "as": F.lag("text", 2).over(beside)})

    @cached_property
    def handed(self) -> DataFrame:
        """(path, idx, component, prop, child, as): props given as they are to a child component: ``<Child as={prop} />``."""
        braces = self.tagged().where("text = '{' AND p1 = '=' AND tag rlike '^[A-Z]'").select("path", F.col("idx").alias("open"), F.col("tag").alias("child"), "as")
        inside = self.source.rows.groupBy("path", F.col("parent").alias("open")).agg(F.count("*").alias("n"), F.min("idx").alias("idx"), F.min("text").alias("prop"), F.min("kind").alias("kind")).where("n = 1 AND kind = 'name'")
        given = self.owned(braces.join(inside, ["path", "open"]).select("path", "idx", "child", "as", "prop"))
        return self.source.saved(given.join(self.props, ["path", "component", "prop"]), "handed")

    def used(self) -> DataFrame:
        """(path, component, prop): props that a component reads other than by handing them on."""
        names = self.tagged().where("kind = 'name' AND coalesce(p1, '') NOT IN ('.', '?.')")
        # the name of an attribute and a key of an object are no uses
        names = names.where("NOT (coalesce(n1, '') = '=' AND tag IS NOT NULL) AND NOT (coalesce(n1, '') = ':' AND coalesce(p1, '{') IN ('{', ','))").select("path", "idx", F.col("text").alias("prop"))
        own = self.owned(names).join(self.props, ["path", "component", "prop"])
        return own.join(self.handed.select("path", "idx"), ["path", "idx"], "left_anti").select("path", "component", "prop").distinct()
