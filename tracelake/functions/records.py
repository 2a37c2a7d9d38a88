"""Column expressions over transcript records: briefs, results, ends, patches, queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import tokens as T

# Names and words that the two transcript formats prescribe.
#: Keys of a tool's input that say what it works on, in order.
BRIEF_KEYS = ["file_path", "path", "pattern", "skill", "command", "description", "prompt", "query", "url", "notebook_path"]
#: What a record says when its user stopped it, and what the service says when it fails.
STOPPED = ["request interrupted", "stopped by the user"]
SERVICE_FAILED, LINE_FAILED = "api error", "connection"
#: What outputs say of their end and time.
SCRIPT_FAILED, IS_ERROR, EXIT_CODE, WALL_TIME = "script failed", '"iserror":true', "exit code:", "wall time"
#: Where a skill's text lies: skills/<name>/SKILL.md.
SKILL_FOLDER, SKILL_TEXT = "skills", "skill.md"
#: Calls inside scripts, the words that declare a variable, and the first line of a patch.
TOOLS, SHELL_CALL, PATCH_CALL = "tools", "shell_command", "apply_patch"
DECLARE = ["const", "let", "var"]
PATCH_HEAD = "*** Begin Patch"
READ_CONTENT = "get-content"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def brief(values: list[Column], size: int = 300) -> Column:
    """The first that isn't blank, white space collapsed, cut at ``size``; else empty."""
    tidy = [F.when(squeeze(v) != "", squeeze(v)) for v in values]
    return F.substring(F.coalesce(*tidy, F.lit("")), 1, size)


def tool_brief(tool_input: Column) -> Column:
    """``brief`` over the known keys of a JSON object."""
    return brief([F.get_json_object(tool_input, f"$.{k}") for k in BRIEF_KEYS])


def line_count(text: Column) -> Column:
    """Lines of a written text: line feeds and one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def abort_reason(kind: Column, text: Column, stop_reason: Column) -> Column:
    """How a stream ended, from its last record: interrupted, api_error, or null for a normal end."""
    low = F.lower(F.coalesce(text, F.lit("")))
    own = kind.eqNullSafe(F.lit("assistant"))
    whole = own & F.coalesce(stop_reason == "end_turn", F.lit(True))
    stopped = F.exists(F.array(*map(F.lit, STOPPED)), lambda x: low.contains(x))
    lost = own & low.contains(SERVICE_FAILED) & (~whole | low.contains(LINE_FAILED))
    return F.when(stopped | (~whole & ~lost), "interrupted").when(lost, "api_error")


def is_terminal(stop_reason: Column, text: Column, has_tool_use: Column) -> Column:
    """Does an assistant message end its turn: by its stop reason, or, without one, text and no tool call."""
    return F.when(stop_reason.isNotNull(), stop_reason.isin("end_turn", "stop_sequence")).otherwise((F.trim(F.coalesce(text, F.lit(""))) != "") & ~has_tool_use)


def tool_failed(output: Column) -> Column:
    low = F.lower(F.coalesce(output, F.lit("")))
    behind = F.ltrim(F.substr(low, F.instr(low, EXIT_CODE) + len(EXIT_CODE), F.length(low)))
    code = F.regexp_extract(F.regexp_replace(behind, r"^\s+", ""), "^-?[0-9]+", 0)
    failed = low.contains(EXIT_CODE) & (code != "") & (F.try_to_number(code, F.lit("S9999999999")) != 0)
    return low.contains(SCRIPT_FAILED) | F.replace(low, F.lit(" "), F.lit("")).contains(IS_ERROR) | failed


def wall_ms(output: Column, start: Column, end: Column) -> Column:
    """The longest wall time that an output reports, else the time between two stamps."""
    pieces = F.split(F.lower(F.coalesce(output, F.lit(""))), WALL_TIME)
    said = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda x: F.split(F.ltrim(F.regexp_replace(x, r"\s+", " ")), " "))
    found = F.transform(F.filter(said, lambda w: T.at(w, F.lit(1)).startswith("seconds")), lambda w: F.get(w, F.lit(0)).try_cast("double"))
    return F.coalesce((F.array_max(found) * 1000).cast("long"), F.timestamp_diff("MILLISECOND", start, end))


def skill_mentions(text: Column) -> Column:
    """Names of the skills whose texts a path names, each once in order."""

    def named(parts: Column) -> Column:
        low = lambda i: F.lower(T.at(parts, i))
        # a path has something before its folder, if only the slash
        spots = T.places(parts, lambda x, i: (i > 2) & F.lower(x).startswith(SKILL_TEXT) & (low(i - 2) == SKILL_FOLDER) & low(i - 1).rlike("^[a-z0-9_-]+$"))
        return F.array_distinct(F.transform(spots, lambda i: T.at(parts, i - 1)))

    return T.bound(F.split(F.coalesce(text, F.lit("")), r"[/\\]+"), named)


def base_skill(name: Column) -> Column:
    return F.element_at(F.split(F.coalesce(name, F.lit("")), ":"), -1)


def query_terms(query: Column) -> Column:
    """Lower-case search terms: identifiers of three characters or more, and pairs of CJK characters."""
    q = F.coalesce(query, F.lit(""))
    names = F.regexp_extract_all(q, F.lit(r"([A-Za-z_][A-Za-z0-9_./:\-]{2,})"), F.lit(1))
    runs = F.regexp_extract_all(q, F.lit("([\u3400-\u9fff]{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.array_distinct(F.transform(F.concat(names, pairs), lambda t: F.lower(t)))


def _calls(tokens: Column, tool: str) -> Column:
    """Where tools.<tool>( begins."""
    return T.places(tokens, lambda x, i: (x == TOOLS) & (T.at(tokens, i + 1) == ".") & (T.at(tokens, i + 2) == tool) & (T.at(tokens, i + 3) == "("))


def unquote(token: Column) -> Column:
    """A JSON string token as text; empty if it isn't one."""
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), token, F.lit("}")), "$.v"), F.lit(""))


def script_field(tokens: Column, key: str, start: Column, end: Column) -> Column:
    """The string that the first field ``key`` of the tokens start .. end - 1 has; null without one."""
    own = T.places(tokens, lambda x, i: (i >= start) & (i < end) & x.isin(key, f'"{key}"') & (T.at(tokens, i + 1) == ":") & T.at(tokens, i + 2).startswith('"'))
    return F.when(F.size(own) > 0, unquote(T.at(tokens, F.get(own, F.lit(0)) + 2)))


def shell_calls(source: Column, cwd: Column) -> Column:
    """array<struct<command, workdir>> of the shell calls inside a script; the fields of a call stand before the next one."""

    def made(t: Column, starts: Column) -> Column:
        ends = lambda k: F.coalesce(F.get(starts, k + 1), F.size(t))
        return F.transform(starts, lambda s, k: F.struct(script_field(t, "command", s, ends(k)).alias("command"), F.coalesce(F.nullif(script_field(t, "workdir", s, ends(k)), F.lit("")), cwd).alias("workdir")))

    calls = T.bound(T.script_tokens(source), lambda t: T.bound(_calls(t, SHELL_CALL), lambda starts: made(t, starts)))
    return F.filter(calls, lambda c: F.coalesce(c["command"], F.lit("")) != "")


def patch_texts(source: Column) -> Column:
    """Patches passed to tools.apply_patch, as a literal or by the name of a variable; the last value of a name counts."""

    def texts(t: Column, made: Column) -> Column:
        args = F.transform(F.filter(_calls(t, PATCH_CALL), lambda i: T.at(t, i + 5) == ")"), lambda i: T.at(t, i + 4))
        value = lambda a: T.at(t, F.element_at(F.filter(made, lambda i: T.at(t, i + 1) == a), -1) + 3)
        known = lambda a: F.exists(made, lambda i: T.at(t, i + 1) == a)
        return F.transform(args, lambda a: F.when(a.startswith('"'), unquote(a)).when(known(a), unquote(value(a))))

    named = lambda t: T.places(t, lambda x, i: x.isin(*DECLARE) & (T.at(t, i + 2) == "=") & T.at(t, i + 3).startswith('"') & (T.at(t, i + 4) == ";"))
    text = T.bound(T.script_tokens(source), lambda t: T.bound(named(t), lambda made: texts(t, made)))
    return F.filter(text, lambda x: F.coalesce(x, F.lit("")).contains(PATCH_HEAD))


def _contents(t: Column) -> Column:
    """What the first quoted text or variable behind each Get-Content of a statement says; null for an unknown variable."""
    reads = T.places(t, lambda x, i: F.lower(x) == READ_CONTENT)
    ends = lambda x: x.isin(";", "|", "\n", "\r")
    shown = F.transform(reads, lambda i: T.first_after(t, i, ends, lambda x: T.is_quoted(x) | x.rlike("^[$][A-Za-z_]")))
    same = lambda i, v: F.lower(T.at(t, i)) == F.lower(v)

    def values(given: Column) -> Column:
        last = lambda v: F.element_at(F.filter(given, lambda i: same(i, v)), -1)
        return F.transform(shown, lambda v: F.when(T.is_quoted(v), T.inner(v)).when(F.exists(given, lambda i: same(i, v)), T.inner(T.at(t, _value(t, last(v))))))

    return T.bound(T.places(t, lambda x, i: x.startswith("$") & (T.at(t, i + 1) == "=") & T.is_quoted(T.at(t, _value(t, i)))), values)


def _value(t: Column, i: Column) -> Column:
    """Where the value of the assignment at ``i`` stands: behind = and, of a list, its first sign or two."""
    behind = i + 2 + F.when(T.at(t, i + 2) == "@", 1).otherwise(0)
    return behind + F.when(T.at(t, behind) == "(", 1).otherwise(0)


def content_paths(command: Column) -> Column:
    """Files that Get-Content names, by a quoted path or a variable, also in commands that are quoted themselves; each once.
    Wild cards and unknown variables name nothing."""

    def values(t: Column) -> Column:
        quoted = F.filter(t, lambda x: T.is_quoted(x) & F.lower(x).contains(READ_CONTENT))
        return F.concat(_contents(t), F.flatten(F.transform(quoted, lambda x: T.bound(T.shell_tokens(T.inner(x)), _contents))))

    return F.array_distinct(F.filter(T.bound(T.shell_tokens(command), values), lambda v: v.isNotNull() & (v != "") & ~v.rlike("[$%*?]")))
