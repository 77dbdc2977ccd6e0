"""JSON and HTML text cut into the pieces that may hold sensitive values.

A piece keeps its place in the original text, so a masked value is spliced back at
its own offsets and every other byte of the document stays as it was. Escapes make a
decoded piece shorter than its source; ``shifts`` lists, for each escape, its decoded
position and how many more characters the source has there.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

from maskloom.functions.spans import SPACE, let, regex_spans, walk

SHIFT = "array<struct<at:int,extra:int>>"
LEAF = "array<struct<path:string,key:string,obj:int,start:int,raw:string>>"
PIECE = "array<struct<start:int,raw:string>>"
DECODED_LEAF = f"struct<path:string,key:string,obj:int,leaf_start:int,text:string,leaf_moved:{SHIFT}>"
DECODED_PIECE = f"struct<start:int,text:string,moved:{SHIFT}>"

_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
JSON_TOKEN = rf'(?s)(?:{_JSON_STRING}|[{{}}\[\]])[^{{}}\[\]"]*+|[^{{}}\[\]"]++'
JSON_ESCAPE = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[^u]"
HTML_ESCAPE = "&(?:#39|amp|lt|gt|quot|nbsp);"

_STATE = "struct<pos:int,objs:int,stack:array<struct<obj:int,path:string>>,path:string,key:string>"


#: Characters of a string that the JVM parser decodes whole; it refuses 20 000 000.
_DECODED_WHOLE = 4_000_000
_DECODE_PARTS = r"(?s)[^\\]{1,65536}+|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[^u]"


def json_string(raw: Column) -> Column:
    """Decode the body of a JSON string token, whatever its length."""

    def decoded(body: Column) -> Column:
        return F.get_json_object(F.concat(F.lit('{"v":"'), body, F.lit('"}')), "$.v")

    parts = F.regexp_extract_all(raw, F.lit(_DECODE_PARTS), F.lit(0))
    long = F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("\\")), decoded(p)).otherwise(p)), "")
    escaped = F.when(F.length(raw) <= _DECODED_WHOLE, decoded(raw)).otherwise(long)
    return F.when(F.contains(raw, F.lit("\\")), escaped).otherwise(raw)


#: Characters up to which a text is listed in Python; so a batch of 10 000 rows stays bounded.
_LISTED = 16_384
_HALF = r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F]"


def _lister(pattern: str):
    """The function behind ``_listed``. It names nothing of this module, so that a task needs no import of it."""
    tokens, lone = re.compile(pattern), re.compile("[\ud800-\udfff]")

    def key_of(raw: str) -> str | None:
        if "\\" not in raw:
            return raw
        try:
            key = json.loads(f'"{raw}"', strict=False)
        except ValueError:
            return None
        return None if lone.search(key) else key  # half a character is none, as in json_string

    def listed(texts: pa.Array) -> pa.Array:
        ends, paths, keys, objects, starts, raws = [0], [], [], [], [], []
        for text in texts.to_pylist():
            pos, objs, top_obj, top_path, path, key, stack = 0, 0, 0, "", "", "", []
            for token in tokens.findall(text or ""):
                sign = token[0]
                if sign == '"':
                    cut = token.rindex('"')
                    if token.find(":", cut) > 0:
                        key = key_of(token[1:cut])
                        path = f"{top_path}.{key}" if top_path and key is not None else key
                    else:
                        paths.append(path)
                        keys.append(key)
                        objects.append(top_obj)
                        starts.append(pos + 1)
                        raws.append(token[1:cut])
                elif sign == "{" or sign == "[":
                    stack.append((top_obj, top_path))
                    if sign == "{":
                        objs += 1
                        top_obj = objs
                    top_path = path or ""
                elif sign == "}" or sign == "]":
                    path, key = top_path, ""
                    top_obj, top_path = stack.pop() if stack else (0, "")
                pos += len(token)
            ends.append(len(paths))
        text, number = pa.string(), pa.int32()
        columns = [pa.array(paths, text), pa.array(keys, text), pa.array(objects, number), pa.array(starts, number), pa.array(raws, text)]
        rows = pa.StructArray.from_arrays(columns, ["path", "key", "obj", "start", "raw"])
        return pa.ListArray.from_arrays(pa.array(ends, number), rows)

    return listed


def _listed(text: Column) -> Column:
    """The leaves of ``_walked``, listed by a small Python function, a batch of texts at a time."""
    return F.arrow_udf(_lister(JSON_TOKEN.replace("*+", "*").replace("++", "+")), LEAF)(text)


def json_leaves(text: Column) -> Column:
    """Every string value of a JSON text: path, key, object number, start, undecoded body.

    An expression costs microseconds a token, so texts of usual length are listed by a small Python
    function; longer ones are walked as an expression, in blocks. So are those with half a
    character, of which each decoder makes something else.
    """
    walked = (F.length(text) > _LISTED) | (F.contains(text, F.lit("\\u")) & text.rlike(_HALF))
    return F.when(walked, _walked(text)).otherwise(_listed(F.when(~walked, text)))


def _walked(text: Column) -> Column:
    """The leaves as an expression.

    The tokens tile the text, so offsets are running lengths. A token is a bracket or a string
    with all that follows it up to the next of them; a colon there makes the string a key. List
    positions add nothing to a path. ``obj`` numbers the object a value sits in.
    """
    tokens = F.transform(
        F.regexp_extract_all(text, F.lit(JSON_TOKEN), F.lit(0)),
        lambda t: F.struct(F.left(t, F.lit(1)).alias("sign"), t.alias("all"), F.substring_index(t, '"', -1).alias("tail")),
    )
    init = F.struct(
        F.lit(0).alias("pos"),
        F.lit(0).alias("objs"),
        F.lit([]).cast("array<struct<obj:int,path:string>>").alias("stack"),
        F.lit("").alias("path"),
        F.lit("").alias("key"),
    ).cast(_STATE)

    def step(acc: Column, token: Column) -> tuple[Column, Column]:
        first, size = token["sign"], F.length(token["all"])
        is_string, is_key = first == '"', F.contains(token["tail"], F.lit(":"))
        raw = F.substring(token["all"], F.lit(2), size - F.length(token["tail"]) - 2)
        top = F.try_element_at(acc["stack"], F.lit(-1))
        top_path = F.coalesce(top["path"], F.lit(""))
        top_obj = F.coalesce(top["obj"], F.lit(0))
        pos = acc["pos"] + size

        def state(path: Column, key: Column, stack: Column = acc["stack"], objs: Column = acc["objs"]) -> Column:
            return F.struct(pos.alias("pos"), objs.alias("objs"), stack.alias("stack"), path.alias("path"), key.alias("key")).cast(_STATE)

        def pushed(obj: Column) -> Column:
            return F.array_append(acc["stack"], F.struct(obj.alias("obj"), acc["path"].alias("path")))

        popped = F.slice(acc["stack"], F.lit(1), F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))
        leaf = F.struct(
            acc["path"].alias("path"), acc["key"].alias("key"), top_obj.alias("obj"), (acc["pos"] + 1).alias("start"), raw.alias("raw")
        )
        keyed = let(json_string(raw), lambda key: state(F.when(top_path == "", key).otherwise(F.concat(top_path, F.lit("."), key)), key))
        after = (
            F.when(is_string & is_key, keyed)
            .when(first == "{", state(acc["path"], acc["key"], pushed(acc["objs"] + 1), acc["objs"] + 1))
            .when(first == "[", state(acc["path"], acc["key"], pushed(top_obj)))
            .when(first.isin("}", "]"), state(top_path, F.lit(""), popped))
            .otherwise(state(acc["path"], acc["key"]))
        )
        return after, F.when(is_string & ~is_key, F.array(leaf).cast(LEAF)).otherwise(F.lit([]).cast(LEAF))

    return walk(tokens, init, LEAF, step)


def siblings(leaves: Column, mark_path: str, mark: str, path: str) -> Column:
    """Leaves at ``path`` whose object also has the value ``mark`` at ``mark_path``: (obj, start, raw)."""
    kind = "array<struct<obj:int,text:boolean,start:int,raw:string>>"
    rows = F.transform(
        F.filter(leaves, lambda x: x["path"].isin(mark_path, path)),
        lambda x: F.struct(x["obj"].alias("obj"), (x["path"] == path).alias("text"), x["start"].alias("start"), x["raw"].alias("raw")),
    )

    def step(acc: Column, row: Column) -> tuple[Column, Column]:
        here = ~row["text"] & (row["raw"] == mark)
        marked = here | ((acc["obj"] == row["obj"]) & acc["marked"])
        after = F.struct(row["obj"].alias("obj"), marked.alias("marked"))
        return after, F.when(row["text"] & marked, F.array(row).cast(kind)).otherwise(F.lit([]).cast(kind))

    return walk(F.array_sort(rows), F.struct(F.lit(-1).alias("obj"), F.lit(False).alias("marked")), kind, step)


def html_text(raw: Column) -> Column:
    out = raw
    for name, char in (("#39", "'"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def html_pieces(text: Column) -> Column:
    """The non-blank text between tags, undecoded, with its offset. Tags are not pieces."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)<[^>]*(?:>|\z)|[^<]+"), F.lit(0))

    def step(pos: Column, t: Column) -> tuple[Column, Column]:
        shown = ~F.startswith(t, F.lit("<")) & t.rlike(rf"[^{SPACE}]")
        piece = F.array(F.struct(pos.alias("start"), t.alias("raw"))).cast(PIECE)
        return pos + F.length(t), F.when(shown, piece).otherwise(F.lit([]).cast(PIECE))

    return walk(tokens, F.lit(0), PIECE, step)


def shifts(raw: Column, escape: str, decoded_length) -> Column:
    """Where decoding ``raw`` made it shorter, and by how much (empty for most pieces)."""

    def step(lost: Column, s: Column) -> tuple[Column, Column]:
        extra = (F.length(s["value"]) - decoded_length(s["value"])).cast("int")
        here = F.struct((s["start"] - lost).cast("int").alias("at"), extra.alias("extra"))
        return (lost + extra).cast("int"), F.array(here)

    return walk(regex_spans(raw, escape), F.lit(0), SHIFT, step)


def json_shifts(raw: Column) -> Column:
    return shifts(raw, JSON_ESCAPE, lambda _: F.lit(1))


def html_shifts(raw: Column) -> Column:
    return shifts(raw, HTML_ESCAPE, lambda _: F.lit(1))


def decoded_leaves(leaves: Column, is_json: bool) -> Column:
    """Leaves with their decoded text and escape shifts."""

    def one(leaf: Column) -> Column:
        text = json_string(leaf["raw"]) if is_json else leaf["raw"]
        moved = json_shifts(leaf["raw"]) if is_json else F.lit([]).cast(SHIFT)
        return F.struct(
            leaf["path"].alias("path"),
            leaf["key"].alias("key"),
            leaf["obj"].alias("obj"),
            leaf["start"].alias("leaf_start"),
            text.alias("text"),
            moved.alias("leaf_moved"),
        ).cast(DECODED_LEAF)

    return F.transform(leaves, one)


def decoded_json(text: Column, leaves: Column) -> Column:
    """The decoded leaves of a JSON text; most texts have no escape, so nothing is to be decoded."""
    return F.when(F.contains(text, F.lit("\\")), decoded_leaves(leaves, True)).otherwise(decoded_leaves(leaves, False))


def decoded_pieces(text: Column, is_html: bool) -> Column:
    """Pieces of a leaf with their decoded text and entity shifts."""
    if not is_html:
        whole = F.struct(F.lit(0).alias("start"), text.alias("text"), F.lit([]).cast(SHIFT).alias("moved"))
        return F.array(whole.cast(DECODED_PIECE))
    return F.transform(
        html_pieces(text),
        lambda p: F.struct(
            p["start"].alias("start"), html_text(p["raw"]).alias("text"), html_shifts(p["raw"]).alias("moved")
        ).cast(DECODED_PIECE),
    )


def source_offset(offset: Column, moved: Column) -> Column:
    """Offset in the undecoded text of a decoded offset."""
    before = F.filter(moved, lambda s: s["at"] < offset)
    return offset + F.aggregate(before, F.lit(0), lambda acc, s: acc + s["extra"])
