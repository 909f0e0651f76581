"""Text and label functions of the code model, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines_of(text: Column) -> Column:
    """The lines of a text: split on newline, without the empty line that a final newline leaves; a CR before it goes."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def numbered_line(number: Column, text: Column) -> Column:
    """``0007 | text``."""
    return F.format_string("%04d | %s", number, text)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def content_hash(content: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(content, 256)


def node_kind(kind: Column) -> Column:
    """Kind of a view node for the kind of a scope entity; unknown kinds are actions."""
    return (
        F.when(kind.isin("function", "method", "type", "interface", "file"), "group")
        .when(kind == "call", "call")
        .when(kind.isin("if", "else"), "decision")
        .when(kind == "loop", "loop")
        .when(kind == "return", "output")
        .when(kind == "variable", "state")
        .otherwise("action")
    )


def layer_of(node_kind: Column) -> Column:
    """Layer by the kind of the entity: calls, data, state, or else flow."""
    return F.when(node_kind == "call", "calls").when(node_kind == "return", "data").when(node_kind == "variable", "state").otherwise("flow")


def script_safe_json(json_text: Column) -> Column:
    """JSON that can stand inside an HTML script element."""
    return F.replace(json_text, F.lit("</"), F.lit("<\\/"))


def extract_json(raw: Column) -> Column:
    """The JSON object in a reply: the trimmed text if it starts with a brace, else from the first ``{`` to the last ``}``; "" if there is none."""
    s = F.trim(raw)
    first, last = F.instr(s, "{"), F.length(s) - F.instr(F.reverse(s), "}") + 1
    return (
        F.when(s.startswith("{"), s)
        .when((first > 0) & F.contains(s, F.lit("}")) & (last > first), F.substr(s, first, last - first + 1))
        .otherwise("")
    )


def matches_search(label: Column, node_id: Column, query: str) -> Column:
    """Case-blind search over label or id."""
    q = query.strip().lower()
    return F.lower(label).contains(q) | F.lower(node_id).contains(q)


def error_line(file: Column, line: Column, message: Column) -> Column:
    """``file:line: message``; without the line where it is 0."""
    return F.when(line > 0, F.concat(file, F.lit(":"), line.cast("string"), F.lit(": "), message)).otherwise(F.concat(file, F.lit(": "), message))


#: What stands before a name in a label, by entity kind.
NAME_PREFIX = {"function": "Функция ", "method": "Функция ", "type": "Тип ", "interface": "Интерфейс ", "variable": "Переменная ", "call": "Вызов "}


def named(name: Column, kind: Column) -> Column:
    """A name with its kind's prefix; the kind alone where there is no name."""
    prefix = F.lit("")
    for k, p in NAME_PREFIX.items():
        prefix = F.when(kind == k, p).otherwise(prefix)
    return F.when(F.coalesce(name, F.lit("")) == "", kind).otherwise(F.concat(prefix, name))


def label_and_summary(kind: Column, label: Column, name: Column, condition: Column) -> tuple[Column, Column]:
    """Label and summary of a scope entity: a given label wins; else branches, loops and returns show their condition, the rest their name."""
    cond = F.coalesce(F.trim(condition), F.lit(""))
    has, given = cond != "", F.coalesce(label, F.lit("")) != ""
    word = F.when(kind == "if", "if").when(kind == "return", "return").when(kind == "loop", F.when(name == "range", "range").otherwise("for"))
    shows = has & (kind.isin("if", "return") | ((kind == "loop") & name.isin("range", "for")))
    text = F.when(given, label).when(kind == "else", "else").when(shows, F.concat(word, F.lit(" "), cond)).when(word.isNotNull(), word).otherwise(named(name, kind))
    return text, F.when(~given & has & kind.isin("if", "loop", "return"), cond)


def error_position(position: Column) -> tuple[Column, Column]:
    """Path and line of ``path:line`` or ``path:line:column``, read from the right; ("", 0) if there is no line."""
    pattern = r"^(.*?):(\d+)(?::(\d+))?$"
    return F.regexp_extract(position, pattern, 1), F.coalesce(F.nullif(F.regexp_extract(position, pattern, 2), F.lit("")).cast("int"), F.lit(0))


def relative_path(root: Column, path: Column) -> Column:
    """path below root, with slashes; other paths as they are."""
    plain = F.translate(path, "\\", "/")
    base = F.concat(F.rtrim(F.translate(root, "\\", "/"), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(plain, base), F.substr(plain, F.length(base) + 1)).otherwise(plain)


def is_within_root(relative: Column) -> Column:
    """Whether a relative path stays inside the root."""
    return ~((relative == "..") | relative.startswith("../") | relative.startswith("/"))


def source_lines(text: Column, start: Column, end: Column) -> Column:
    """Numbered lines start to end of a text, joined; "" without a start."""
    some = F.filter(F.transform(lines_of(text), lambda x, i: F.when((i + 1 >= start) & (i + 1 <= end), numbered_line(i + 1, x))), lambda x: x.isNotNull())
    return F.when(start.isNotNull(), F.array_join(some, "\n")).otherwise("")


#: Pixels that a character takes, narrow ones and all others: a fixed stand-in for a browser's font.
NARROW, CHAR_WIDTH, NARROW_WIDTH = "[ijl.,:;'|!()\\[\\]1 ]", 8, 4


def text_width(text: Column) -> Column:
    narrow = F.size(F.split(text, NARROW, -1)) - 1
    return F.length(text) * CHAR_WIDTH - narrow * (CHAR_WIDTH - NARROW_WIDTH)


def wrap(text: Column, width: int) -> Column:
    """Lines of whole words that fit the width; a longer word has a line of its own."""
    empty = F.array().cast("array<string>")

    def add(lines: Column, word: Column) -> Column:
        longer = F.concat(F.element_at(lines, -1), F.lit(" "), word)
        fits = (F.size(lines) > 0) & (text_width(F.coalesce(longer, F.lit(""))) <= width)
        return F.when(fits, F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(F.array_remove(F.split(text, r"\s+"), ""), empty, lambda lines, w: F.when(F.size(lines) == 0, F.array(w)).otherwise(add(F.when(F.size(lines) == 0, F.array(F.lit(""))).otherwise(lines), w)))


def node_size(kind: Column, label: Column) -> tuple[Column, Column]:
    """Width and height of a node's box: width by its label, within 140 to 300 pixels (decisions 168 to 280), height by wrapped lines."""
    low, high = F.when(kind == "decision", 168).otherwise(140), F.when(kind == "decision", 280).otherwise(300)
    width = F.least(F.greatest(text_width(label) + 32, low), high).cast("int")
    lines = F.when(kind == "decision", F.size(wrap(label, 280 - 32))).otherwise(F.size(wrap(label, 300 - 32)))
    return width, (F.greatest(lines, F.lit(1)) * 18 + 26).cast("int")


def status_text(status: Column) -> Column:
    """What the user reads for a file's status."""
    return F.when(status == "ready", "готово").when(status == "analyzing", "анализ").when(status == "error", "ошибка").otherwise("ожидает")
