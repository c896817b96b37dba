"""Document validation as column expressions, compiled from a JSON Schema.

The compiler walks the schema once on the driver and writes Spark SQL text: one
check per (path, keyword). At run time every document is parsed once into a
Variant, stamped fields are merged into it, and each object node of the schema is
materialised once as a Variant column; checks are short lookups on those columns.
Everything is a narrow projection: no UDF, no shuffle, one pass per partition.

The result column is ``ARRAY<STRUCT<path, rule, message>>``, empty when valid,
sorted by (path, rule). Supported keywords (those the intake schema uses):
``type``, ``properties``, ``required``, ``additionalProperties``,
``minProperties``, ``maxProperties``, ``minLength``, ``maxLength``, ``pattern``,
``enum``, ``format: date-time``, ``items`` and local ``$ref``. Messages follow
the wording of the common Java draft-04 validator; the missing-required text is
exact, with names in schema order.

Stamping (``overrides``) is the deep merge done before validation: the values are
set at the given paths, missing or non-object parents on those paths become
objects, and everything else is validated as sent.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passlane.functions.request_schema import REQUEST_SCHEMA

ERROR_TYPE = "array<struct<path:string,rule:string,message:string>>"
EMPTY = f"CAST(array() AS {ERROR_TYPE})"

DATE_TIME_RE = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
                r"(\.[0-9]{1,12})?(Z|[+-][0-9]{2}:[0-9]{2})$")
DATE_TIME_FORMATS = "[yyyy-MM-dd'T'HH:mm:ssZ, yyyy-MM-dd'T'HH:mm:ss.[0-9]{1,12}Z]"
INTEGER_TYPES = "('TINYINT', 'SMALLINT', 'INT', 'BIGINT')"


def sql_str(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lit_json(value) -> str:
    return json.dumps(value, separators=(",", ":"))


def _key_path(keys: list[str]) -> str:
    return "$" + "".join(f"[{json.dumps(k)}]" for k in keys)


class SchemaTables:
    """The schema compiled to lookup tables keyed by schema-node id.

    Every distinct (resolved) schema node gets an integer id; keywords become
    small literal maps ``id → argument``. Child lookup is ``"<id>/<key>" → id`` and
    ``id → item id``. The maps are fixed by the schema, not by the data, so the
    generated expression has the same small size for any document.
    """

    def __init__(self, schema: dict):
        self.schema = schema
        self.ids: dict[int, int] = {}
        self.nodes: list[dict] = []
        self.depth = 0
        self._visit(schema, 0)

    def resolve(self, sch: dict) -> dict:
        while "$ref" in sch:
            ref = sch["$ref"]
            if not ref.startswith("#/"):
                raise ValueError(f"only local $ref is supported: {ref}")
            target = self.schema
            for part in ref[2:].split("/"):
                target = target[part]
            sch = target
        return sch

    def _visit(self, sch: dict, depth: int) -> int:
        sch = self.resolve(sch)
        self.depth = max(self.depth, depth)
        if id(sch) in self.ids:
            return self.ids[id(sch)]
        sid = len(self.nodes)
        self.ids[id(sch)] = sid
        self.nodes.append(sch)
        for sub in sch.get("properties", {}).values():
            self._visit(sub, depth + 1)
        if "items" in sch:
            self._visit(sch["items"], depth + 1)
        return sid

    def sid(self, sch: dict) -> int:
        return self.ids[id(self.resolve(sch))]

    def patterns(self) -> list[str]:
        seen: list[str] = []
        for sch in self.nodes:
            p = sch.get("pattern")
            if p is not None and p not in seen:
                seen.append(p)
        return seen


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``: a one-element transform."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _json_list(arr: str) -> str:
    return f"concat('[', array_join(transform({arr}, r -> concat('\"', r, '\"')), ','), ']')"


NODE_TYPE = ("struct<path:string,sid:int,m:map<string,variant>,ty:string,keys:array<string>,"
             "arr:array<variant>,s:string>")
NODE_ARRAY = f"array<{NODE_TYPE}>"
RULE_TYPE = ("struct<types:array<string>,maxlen:int,minlen:int,pat:int,dt:boolean,"
             "enums:array<string>,enum_text:string,required:array<string>,"
             "allowed:array<string>,maxp:int,minp:int,item:int,"
             "child_keys:array<string>,child_sids:array<int>>")


def _members_sql(path: str, v: str, stamps: dict) -> str:
    """The members of the object at ``v``, stamped: what is to be set at ``path`` replaces members of
    the same names, and a parent of what is set further down is an object (the root stays what it is)."""
    m = f"try_variant_get({v}, '$', 'map<string,variant>')"

    def cases(tree: dict, at: str) -> list[str]:
        names = ", ".join(sql_str(k) for k in tree)
        new = ", ".join(
            f"{sql_str(k)}, " + (f"try_variant_get({v}, {sql_str(_key_path([k]))}, 'variant')" if isinstance(x, dict)
                                 else f"CAST({x} AS VARIANT)") for k, x in tree.items())
        kept = m if not at else f"coalesce({m}, CAST(map() AS map<string,variant>))"
        here = f"map_concat(map_filter({kept}, (k, x) -> NOT array_contains(array({names}), k)), map({new}))"
        return [f"WHEN {sql_str(at)} THEN {here}",
                *[c for k, x in tree.items() if isinstance(x, dict) for c in cases(x, f"{at}/{k}")]]

    return f"CASE {path} {' '.join(cases(stamps, ''))} ELSE {m} END" if stamps else m


def _node_sql(path: str, sid: str, v: str, stamps: dict) -> str:
    """A node struct with its type, object members (stamped), array items and string value.

    The members and items are cast once and bound to ``q``; only a leaf is asked for its type
    and text, which for an object or array would walk the whole subtree."""
    parts = (f"named_struct('m', {_members_sql(path, v, stamps)}, "
             f"'a', try_variant_get({v}, '$', 'array<variant>'))")
    return (f"element_at(transform(array({parts}), q -> named_struct('path', {path}, 'sid', {sid}, 'm', q.m, "
            f"'ty', CASE WHEN q.m IS NOT NULL THEN 'OBJECT' WHEN q.a IS NOT NULL THEN 'ARRAY' "
            f"ELSE schema_of_variant({v}) END, 'keys', map_keys(q.m), 'arr', q.a, "
            f"'s', CASE WHEN q.m IS NULL AND q.a IS NULL THEN try_variant_get({v}, '$', 'string') END)), 1)")


class SchemaCompiler:
    """SQL text for node expansion and for the per-node rule check.

    The schema becomes one literal array of rule structs indexed by node id (``__rules``,
    constant-folded by the optimizer, so a lookup is an O(1) array access).
    """

    def __init__(self, schema: dict):
        self.t = SchemaTables(schema)
        self.patterns = self.t.patterns()

    def rules_sql(self) -> str:
        t = self.t

        def arr(vals, typ="string"):
            if vals is None:
                return f"CAST(NULL AS array<{typ}>)"
            if not vals:
                return f"CAST(array() AS array<{typ}>)"
            return "array(" + ", ".join(sql_str(v) if typ == "string" else str(v) for v in vals) + ")"

        def num(v):
            return "CAST(NULL AS INT)" if v is None else str(int(v))

        rows = []
        for sch in t.nodes:
            types = (sch["type"] if isinstance(sch["type"], list) else [sch["type"]]) \
                if "type" in sch else None
            props = sch.get("properties", {})
            enums = [v for v in sch["enum"] if isinstance(v, str)] if "enum" in sch else None
            rows.append(
                "named_struct("
                f"'types', {arr(types)}, 'maxlen', {num(sch.get('maxLength'))}, "
                f"'minlen', {num(sch.get('minLength'))}, "
                f"'pat', {num(self.patterns.index(sch['pattern']) if 'pattern' in sch else None)}, "
                f"'dt', {'true' if sch.get('format') == 'date-time' else 'false'}, "
                f"'enums', {arr(enums)}, "
                f"'enum_text', {sql_str(_lit_json(sch['enum'])) if 'enum' in sch else 'CAST(NULL AS STRING)'}, "
                f"'required', {arr(sch.get('required'))}, "
                f"'allowed', {arr(list(props) if sch.get('additionalProperties') is False else None)}, "
                f"'maxp', {num(sch.get('maxProperties'))}, 'minp', {num(sch.get('minProperties'))}, "
                f"'item', {num(t.sid(sch['items']) if 'items' in sch else None)}, "
                f"'child_keys', {arr(list(props))}, "
                f"'child_sids', {arr([t.sid(x) for x in props.values()], 'int')})"
            )
        return f"CAST(array({', '.join(rows)}) AS array<{RULE_TYPE}>)"

    def expand_sql(self, level_col: str, stamps: dict) -> str:
        """Children of every node of a level: object members known to the schema,
        then array items. Unknown members are not expanded (the parent reports them), nor are
        those whose path is in ``__settled``."""
        r = "element_at(__rules, n.sid + 1)"
        members = (
            "transform(filter(map_entries(n.m), e -> array_contains(r.child_keys, e.key) "
            "AND NOT array_contains(__settled, concat(n.path, '/', e.key))), "
            "e -> " + _node_sql("concat(n.path, '/', e.key)",
                                "element_at(r.child_sids, CAST(array_position(r.child_keys, e.key) AS INT))",
                                "e.value", stamps) + ")"
        )
        items = (
            "CASE WHEN r.item IS NOT NULL AND n.arr IS NOT NULL THEN transform(n.arr, (x, i) -> "
            + _node_sql("concat(n.path, '/', CAST(i AS STRING))", "r.item", "x", {}) + ") END"
        )
        body = (f"CASE WHEN n.keys IS NOT NULL AND size(r.child_keys) > 0 THEN {members} "
                f"ELSE CAST(array() AS {NODE_ARRAY}) END")
        # ``r`` is bound per node through a one-element transform (a lambda let).
        return (f"flatten(transform({level_col}, n -> element_at(transform(array({r}), r -> "
                f"concat({body}, coalesce({items}, CAST(array() AS {NODE_ARRAY})))), 1)))")

    def check_sql(self, nodes_col: str) -> str:
        """ARRAY<STRUCT<path, rule, message>> of every violation among the nodes."""
        pats = self.patterns
        is_str = "(n.ty = 'STRING')"
        tname = (f"CASE WHEN n.ty = 'STRING' THEN 'string' WHEN n.ty = 'BOOLEAN' THEN 'boolean' "
                 f"WHEN n.ty IN {INTEGER_TYPES} THEN 'integer' WHEN n.keys IS NOT NULL THEN 'object' "
                 f"WHEN n.arr IS NOT NULL THEN 'array' WHEN n.ty = 'VOID' THEN 'null' ELSE 'number' END")
        type_ok = f"array_contains(r.types, {tname}) OR (array_contains(r.types, 'number') AND {tname} = 'integer')"
        n_len = "char_length(n.s)"
        pattern_ok = ("CASE r.pat " + " ".join(
            f"WHEN {i} THEN n.s RLIKE {sql_str(p)}" for i, p in enumerate(pats)) + " ELSE true END"
        ) if pats else "true"
        pat_text = ("CASE r.pat " + " ".join(
            f"WHEN {i} THEN {sql_str(json.dumps(p))}" for i, p in enumerate(pats)) + " END"
        ) if pats else "CAST(NULL AS STRING)"
        missing = "filter(r.required, x -> NOT array_contains(n.keys, x))"
        extra = "array_sort(array_except(n.keys, r.allowed))"
        dt_valid = (f"(n.s RLIKE {sql_str(DATE_TIME_RE)} AND try_to_timestamp(substring(n.s, 1, 19), "
                    f"\"yyyy-MM-dd'T'HH:mm:ss\") IS NOT NULL)")
        q = "concat('\"', n.s, '\"')"

        def err(rule: str, msg: str) -> str:
            return f"named_struct('path', n.path, 'rule', {sql_str(rule)}, 'message', CAST({msg} AS STRING))"

        checks = [
            f"CASE WHEN r.types IS NOT NULL AND NOT ({type_ok}) THEN " + err(
                "type", f"concat('instance type (', {tname}, ') does not match any allowed "
                        f"primitive type (allowed: ', {_json_list('r.types')}, ')')") + " END",
            f"CASE WHEN {is_str} AND {n_len} > r.maxlen THEN " + err(
                "maxLength", f"concat('string ', {q}, ' is too long (length: ', CAST({n_len} AS STRING), "
                             f"', maximum allowed: ', CAST(r.maxlen AS STRING), ')')") + " END",
            f"CASE WHEN {is_str} AND {n_len} < r.minlen THEN " + err(
                "minLength", f"concat('string ', {q}, ' is too short (length: ', CAST({n_len} AS STRING), "
                             f"', required minimum: ', CAST(r.minlen AS STRING), ')')") + " END",
            f"CASE WHEN {is_str} AND r.pat IS NOT NULL AND NOT ({pattern_ok}) THEN " + err(
                "pattern", f"concat('ECMA 262 regex ', {pat_text}, ' does not match input string ', {q})")
            + " END",
            f"CASE WHEN r.dt AND {is_str} AND NOT {dt_valid} THEN " + err(
                "format", f"concat('string ', {q}, "
                          f"{sql_str(' is invalid against requested date format(s) ' + DATE_TIME_FORMATS)})")
            + " END",
            f"CASE WHEN r.enums IS NOT NULL AND NOT ({is_str} AND array_contains(r.enums, n.s)) THEN " + err(
                "enum", f"concat('instance value (', CASE WHEN {is_str} THEN {q} ELSE {tname} END, "
                        f"') not found in enum (possible values: ', r.enum_text, ')')") + " END",
            f"CASE WHEN r.required IS NOT NULL AND n.keys IS NOT NULL AND size({missing}) > 0 THEN " + err(
                "required", f"concat('object has missing required properties (', {_json_list(missing)}, ')')")
            + " END",
            f"CASE WHEN r.allowed IS NOT NULL AND n.keys IS NOT NULL AND size({extra}) > 0 THEN " + err(
                "additionalProperties", f"concat('object instance has properties which are not allowed by "
                                        f"the schema: ', {_json_list(extra)})") + " END",
            f"CASE WHEN n.keys IS NOT NULL AND size(n.keys) > r.maxp THEN " + err(
                "maxProperties", "concat('object has too many properties (found ', CAST(size(n.keys) AS STRING), "
                                 "', maximum allowed: ', CAST(r.maxp AS STRING), ')')") + " END",
            f"CASE WHEN n.keys IS NOT NULL AND size(n.keys) < r.minp THEN " + err(
                "minProperties", "concat('object has too few properties (found ', CAST(size(n.keys) AS STRING), "
                                 "', required minimum: ', CAST(r.minp AS STRING), ')')") + " END",
        ]
        r = "element_at(__rules, n.sid + 1)"
        per_node = (f"element_at(transform(array({r}), r -> "
                    f"filter(array({', '.join(checks)}), e -> e IS NOT NULL)), 1)")
        return f"array_sort(CAST(flatten(transform({nodes_col}, n -> {per_node})) AS {ERROR_TYPE}))"


class FastCheck:
    """One regular expression over the text as sent that matches only documents without any violation.

    Members are taken in any order. It is read beside the parsed document, so the text is known to be
    JSON: brackets are balanced, members of an object have distinct names, and commas need no check.
    What the expression cannot settle (an unknown member that is no scalar, a string with unicode
    escapes, a 29th of February) it leaves to the full check: no match is no verdict. All loops are
    possessive, so that a document of any length is read once, without backtracking or recursion.
    """

    BLANK = r"\s*+"
    CHAR = r'(?:[^"\\]|\\["\\/bfnrt])'
    STRING = r'"(?:[^"\\]++|\\.)*+"'
    SCALAR = f"(?:{STRING}|[-+.\\w]++)"
    #: Members of the root that the schema does not name may be nested this deep.
    DEPTH = 8
    #: Objects with at most this many levels below are also settled by themselves.
    LOW = 3
    #: Patterns that can match no quote, and so end where the string ends.
    PLAIN = r"\^?(?:\[[0-9A-Za-z.]+(?:-[0-9A-Za-z]+)*\]|[0-9A-Za-z:-]|\{\d+(?:,\d+)?\}|\?)+\$?"
    DATE_TIME = (r"[12][0-9]{3}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1[0-9]|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)"
                 r"|(?:0[13578]|1[02])-31)T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z")

    def __init__(self, compiler: SchemaCompiler, stamped: tuple[tuple[str, ...], ...] = ()):
        self.t, self.stamped, self.marks = compiler.t, set(stamped), 0

    def anything(self) -> str:
        """Any JSON value nested no deeper than ``DEPTH``."""
        inner = ""
        for _ in range(self.DEPTH):
            inner = f'[\\[{{](?:[^"\\[\\]{{}}]++|{self.STRING}{inner and "|"}{inner})*+[\\]}}]'
        return f"(?:{self.SCALAR}|{inner})"

    def string(self, sch: dict) -> str | None:
        tests = []
        if "pattern" in sch:
            if not re.fullmatch(self.PLAIN, sch["pattern"]):
                return None
            tests.append(sch["pattern"].removeprefix("^").removesuffix("$"))
        if "enum" in sch:
            known = [v for v in sch["enum"] if isinstance(v, str) and re.fullmatch("[0-9A-Za-z_ -]+", v)]
            if not known:
                return None
            tests.append("|".join(known))
        if sch.get("format") == "date-time":
            tests.append(self.DATE_TIME)
        size = f"{{{int(sch.get('minLength', 0))},{int(sch['maxLength']) if 'maxLength' in sch else ''}}}+"
        return '"' + "".join(f'(?=(?:{t})")' for t in tests) + self.CHAR + size + '"'

    def shape(self, sch: dict, path: tuple[str, ...], listed: bool = False) -> str | None:
        """Matches the text of a value that is valid; None if no such expression can be given.

        ``listed``: of an item of a list."""
        sch = self.t.resolve(sch)
        kind = sch.get("type")
        if kind == "string":
            return self.string(sch)
        if kind == "boolean" and "enum" not in sch:
            return "(?:true|false)"
        if kind == "array" and "enum" not in sch and "items" in sch and not listed:
            item = self.shape(sch["items"], (*path, "*"), listed=True)
            return item and f"\\[{self.BLANK}(?:{item}[\\s,]*+)*+\\]"
        if kind != "object" or "enum" in sch:
            return None
        return self.members(sch, path, listed)

    def members(self, sch: dict, path: tuple[str, ...], listed: bool) -> str | None:
        """Matches an object with valid members in any order."""
        props, needed = sch.get("properties", {}), sch.get("required", [])
        least, most = sch.get("minProperties", 0), sch.get("maxProperties", "")
        if any(not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", k) for k in (*props, *needed)) or not set(needed) <= set(props):
            return None
        named = {k for k in props if (*path, k) in self.stamped}
        if least > max(1, len(needed)) or (named and (least > 1 or most != "")):
            return None
        flat = all(self.t.resolve(v).get("type") in ("string", "boolean") for v in props.values())
        if listed and not flat:
            return None
        ahead, after, ways = "", "", []
        for k, v in props.items():
            mark = ""
            if k in needed and k not in named:
                if listed:  # a mark would outlast the item
                    ahead += f'(?=[^{{}}]*?"{k}"{self.BLANK}:)'
                else:
                    self.marks += 1
                    mark, after = f"(?<m{self.marks}>)", after + f"\\k<m{self.marks}>"
            value = self.SCALAR if k in named else self.shape(v, (*path, k))
            if value is None:
                return None
            ways.append(f'{k}"{self.BLANK}:{self.BLANK}{value}{mark}')
        if sch.get("additionalProperties") is not False:
            other = f'(?!(?:{"|".join(props)})")' if props else ""
            ways.append(f'{other}[^"\\\\]*+"{self.BLANK}:{self.BLANK}{self.SCALAR if path else self.anything()}')
        body = f'(?:"(?:{"|".join(ways)})[\\s,]*+){{{least},{most}}}+' if ways else ""
        return f"\\{{{ahead}{self.BLANK}{body}\\}}{after}"

    def columns(self, doc: str, text: str) -> tuple[dict[str, str], str] | None:
        """(helper columns, predicate over them) for the parsed document ``doc`` with its ``text``, or None."""
        root = self.t.resolve(self.t.schema)
        shape = self.shape(root, ()) if root.get("type") == "object" else None
        if shape is None:
            return None
        return {}, f"coalesce({doc} IS NOT NULL AND {text} RLIKE {sql_str(f'^{self.BLANK}{shape}{self.BLANK}$')}, false)"

    # -- parts of a document that breaks a rule elsewhere

    def height(self, sch: dict) -> int:
        sch = self.t.resolve(sch)
        below = [*sch.get("properties", {}).values(), *([sch["items"]] if "items" in sch else [])]
        return 1 + max(map(self.height, below)) if below else 0

    def sections(self, sch: dict, path: tuple[str, ...]) -> dict | str | None:
        """Shapes of the low objects at and below ``path``, in a tree of member names."""
        sch = self.t.resolve(sch)
        if sch.get("type") != "object":
            return None
        if path and self.height(sch) <= self.LOW and not any(p[:len(path)] == path for p in self.stamped):
            return self.shape(sch, path)
        props = sch.get("properties", {})
        if len({k.lower() for k in props}) < len(props) or any("`" in k for k in props):
            return None
        return {k: x for k, v in props.items() if (x := self.sections(v, (*path, k)))} or None

    def settled_sql(self, doc: str, text: str) -> str:
        """Paths of the low objects of the document ``doc``, sent as ``text``, that are certainly without a violation."""
        def ddl(tree: dict | str) -> str:
            if isinstance(tree, str):
                return "string"
            return f"struct<{','.join(f'`{k}`:{ddl(v)}' for k, v in tree.items())}>"

        def tests(tree: dict | str, at: str, path: tuple[str, ...]) -> list[str]:
            if isinstance(tree, dict):
                return [c for k, v in tree.items() for c in tests(v, f"{at}.`{k}`", (*path, k))]
            # the text of a string may look like that of an object
            return [f"CASE WHEN {at} RLIKE {sql_str(f'^{self.BLANK}{tree}{self.BLANK}$')} AND try_variant_get({doc}, "
                    f"{sql_str(_key_path(list(path)))}, 'map<string,variant>') IS NOT NULL THEN {sql_str('/' + '/'.join(path))} END"]

        tree = self.sections(self.t.schema, ())
        if not isinstance(tree, dict):
            return "CAST(array() AS array<string>)"
        found = f"array_compact(array({', '.join(tests(tree, '__texts', ()))}))"
        return _let("__texts", f"from_json({text}, {sql_str(ddl(tree))})", found)


def _merge_sql(var: str, tree: dict) -> str:
    """Deep merge of a tree of (key → value SQL | subtree) into the object at ``var``."""
    m = f"coalesce(try_variant_get({var}, '$', 'map<string,variant>'), CAST(map() AS map<string,variant>))"
    names = ", ".join(sql_str(k) for k in tree)
    new = []
    for k, v in tree.items():
        if isinstance(v, dict):
            child = f"try_variant_get({var}, {sql_str(_key_path([k]))}, 'variant')"
            new.append(f"{sql_str(k)}, {_merge_sql(child, v)}")
        else:
            new.append(f"{sql_str(k)}, CAST({v} AS VARIANT)")
    return (f"to_variant_object(map_concat(map_filter({m}, (k, x) -> NOT array_contains(array({names}), k)), "
            f"map({', '.join(new)})))")


def _override_tree(overrides: dict[tuple[str, ...], str]) -> dict:
    tree: dict = {}
    for path, value in overrides.items():
        t = tree
        for p in path[:-1]:
            t = t.setdefault(p, {})
        t[path[-1]] = value
    return tree


ACK_PATH = ("simpleDeclarationRequest", "requestCommon", "acknowledgementReference")
REF_PATH = ("simpleDeclarationRequest", "requestDetail", "declarationHeader", "chargeReference")


def stamp_overrides(reference_col: str) -> dict[tuple[str, ...], str]:
    """The two fields a numbered submission is stamped with (SQL text)."""
    return {ACK_PATH: f"concat(`{reference_col}`, '0')", REF_PATH: f"`{reference_col}`"}


def with_variant(df: DataFrame, col: str, out: str) -> DataFrame:
    """``out``: the JSON text of a column as a Variant, null if it is none; parsed once.

    A generator of one row: what is computed from it reads the parsed value, where a plain
    column would be parsed anew in every expression that the optimizer moves it into."""
    return df.select("*", F.explode(F.array(F.expr(f"try_parse_json(`{col}`)"))).alias(out))


def with_document(df: DataFrame, raw_col: str = "raw", reference_col: str | None = None,
                  doc_col: str = "__doc", keep_parsed: bool = False) -> DataFrame:
    """Adds the parsed (and, with a reference, stamped) document as a Variant column.

    A body that does not parse, or whose root is not an object, is not stamped.
    """
    df = with_variant(df, raw_col, "__parsed").withColumn(doc_col, F.expr(_document_sql(reference_col)))
    return df if keep_parsed else df.drop("__parsed")


def _document_sql(reference_col: str | None) -> str:
    """The parsed document ``__parsed``, stamped if there is a reference and its root is an object."""
    if not reference_col:
        return "__parsed"
    merged = _merge_sql("__parsed", _override_tree(stamp_overrides(reference_col)))
    return f"CASE WHEN try_variant_get(__parsed, '$', 'map<string,variant>') IS NOT NULL THEN {merged} ELSE __parsed END"


def _stamped(stamped: bool) -> tuple[tuple[str, ...], ...]:
    return (ACK_PATH, REF_PATH) if stamped else ()


def _with_verdict(df: DataFrame, compiler: SchemaCompiler, raw_col: str, stamped: bool) -> tuple[DataFrame, str]:
    """``df`` with ``__sound`` (true: certainly no violation), and the SQL to read it by.

    It looks at the document as sent: where the parents of the stamped members are objects,
    stamping changes those members alone, and to valid values."""
    fast = FastCheck(compiler, _stamped(stamped)).columns("__parsed", f"`{raw_col}`")
    if fast is None:
        return df, "false"
    helpers, predicate = fast
    for name, sql in helpers.items():
        df = df.withColumn(name, F.expr(sql))
    return df.select("*", F.explode(F.array(F.expr(predicate))).alias("__sound")).drop(*helpers), "__sound"


def validate_documents(df: DataFrame, raw_col: str = "raw", reference_col: str | None = None,
                       schema: dict | None = None) -> DataFrame:
    """Adds ``errors`` (empty array = valid), the document ``__doc`` and what was sent, ``__parsed``.

    A body that is not JSON gives one ``parse`` error; a root that is not an object
    is reported by the root ``type`` rule. A flat predicate (``FastCheck``) first settles
    the documents without a violation; only the others are expanded, one projection per
    schema level, to build their error texts. The last step is a one-row generator: filters on
    ``errors`` then stay above it and read the computed value (a Project would let the
    optimizer push the filter down with the rule expression substituted in).
    """
    compiler = SchemaCompiler(schema or REQUEST_SCHEMA)
    before = df.columns
    df, sound = _with_verdict(with_document(df, raw_col, reference_col, keep_parsed=True), compiler, raw_col, bool(reference_col))
    settled = "CAST(array() AS array<string>)"
    if sound != "false":
        settled = FastCheck(compiler, _stamped(bool(reference_col))).settled_sql("__parsed", f"`{raw_col}`")
    # the document is stamped node by node; ``__doc`` is built only where it is asked for
    stamps = _override_tree(stamp_overrides(reference_col)) if reference_col else {}
    levels = [f"__lvl{k}" for k in range(compiler.t.depth + 1)]
    found = compiler.check_sql(f"concat({', '.join(levels)})")
    # levels and rules are bound by lambdas: as columns they would be copied for every projection
    for level, above in reversed(list(zip(levels[1:], levels, strict=False))):
        found = _let(level, compiler.expand_sql(above, stamps), found)
    found = _let(levels[0], f"array({_node_sql(chr(39) * 2, '0', '__parsed', stamps)})", found)
    found = _let("__settled", settled, _let("__rules", compiler.rules_sql(), found))
    errors = (f"CASE WHEN {sound} THEN {EMPTY} WHEN __parsed IS NULL THEN array(named_struct('path', '', 'rule', 'parse', "
              f"'message', 'document is not valid JSON')) ELSE {found} END")
    return df.select(*before, "__doc", "__parsed", F.explode(F.array(F.expr(errors))).alias("errors"))


def validation_errors(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """One row per error: key columns + path, rule, message."""
    return (df.select(*key_cols, F.explode("errors").alias("e"))
            .select(*key_cols, "e.path", "e.rule", "e.message"))


def validation_summary(errors: DataFrame) -> DataFrame:
    """Documents per (path, rule): partial aggregation before the shuffle."""
    return (errors.groupBy("path", "rule")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))
