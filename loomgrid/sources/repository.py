"""A repository of many languages made from the plain tables: expressions in the SQL that Spark and DuckDB share."""

from __future__ import annotations


def path(k: str) -> str:
    """A file's path by its key."""
    return (
        f"case {k} % 8 when 0 then 'src/pkg' || ({k} % 25) || case when {k} % 5 = 0 then '/__init__.py' else '/mod' || ({k} % 60) || '.py' end when 1 then 'tools/t' || ({k} % 30) || '.py' "
        f"when 2 then 'web/c' || ({k} % 20) || case {k} % 3 when 0 then '/index.ts' when 1 then '/v' || ({k} % 90) || '.tsx' else '/v' || ({k} % 90) || '.js' end when 3 then 'go/svc' || ({k} % 15) || '/f' || {k} || case when {k} % 11 = 0 then '_test.go' else '.go' end "
        f"when 4 then 'java/app' || ({k} % 10) || '/com/acme/K' || ({k} % 300) || '.java' when 5 then 'src/rs' || ({k} % 12) || case when {k} % 4 = 1 then '/mod.rs' else '/r' || ({k} % 50) || '.rs' end "
        f"when 6 then 'c/lib' || ({k} % 9) || '/h' || ({k} % 200) || '.h' else 'rb/x' || ({k} % 6) || '/y' || ({k} % 80) || '.rb' end"
    )


def declaration(k: str, t: str, v: str) -> str:
    """What file k says to import file t of its language, in the form v of seven."""
    python = (
        f"case {v} when 1 then 'import pkg' || ({t} % 25) || '.mod' || ({t} % 60) when 2 then 'from pkg' || ({t} % 25) || ' import mod' || ({t} % 60) || ', helper' when 3 then 'from . import mod' || ({t} % 60) "
        f"when 4 then 'from ..pkg' || ({t} % 25) || ' import mod' || ({t} % 60) || ' as m' when 5 then 'import os.path, t' || ({t} % 30) when 6 then 'from pkg' || ({t} % 25) || ' import (mod' || ({t} % 60) || ', mod' || ({t} % 7) || ')' else 'import pkg' || ({t} % 25) || ' as p' end"
    )
    script = (
        f"case {v} when 1 then 'import x from \"./v' || ({t} % 90) || '\"' when 2 then 'import \"../c' || ({t} % 20) || '\"' when 3 then 'const a = require(\"../c' || ({t} % 20) || '/v' || ({t} % 90) || '.js\")' when 4 then 'import y from \"react\"' "
        f"when 5 then 'export * from \"../../../up' || {t} || '\"' when 6 then './v' || ({t} % 90) || '.jsx' else 'import z' end"
    )
    go = f"case when {v} < 4 then 'import \"acme.org/go/svc' || ({t} % 15) || '\"' when {v} = 4 then 'import f \"acme.org/go/missing' || ({t} % 3) || '\"' when {v} = 5 then 'import \"fmt\"' when {v} = 6 then 'import \"acme.org/svc' || ({t} % 15) || '\"' else 'import \"acme.org/got\"' end"
    java = f"case when {v} < 4 then 'import com.acme.K' || ({t} % 300) || ';' when {v} = 4 then 'import static com.acme.K' || ({t} % 300) || '.make;' when {v} = 5 then 'import java.util.*;' when {v} = 6 then 'import app' || ({t} % 10) || '.com.acme.K' || ({t} % 300) else 'package x y' end"
    rust = f"case {v} when 1 then 'use crate::rs' || ({t} % 12) || '::r' || ({t} % 50) || '::Thing;' when 2 then 'use self::r' || ({t} % 50) when 3 then 'use super::rs' || ({t} % 12) when 4 then 'use std::io' when 5 then 'use crate::rs' || ({t} % 12) || '::r' || ({t} % 50) when 6 then 'use super::rs' || ({t} % 12) || '::r' || ({t} % 50) || '::A::B' else 'use crate' end"
    header = f"case {v} when 1 then '#include \"h' || ({t} % 200) || '.h\"' when 2 then '#include <lib' || ({t} % 9) || '/h' || ({t} % 200) || '.h>' when 3 then '#include <stdio.h>' when 4 then '#include <sys/h' || ({t} % 200) || '.h>' when 5 then '#  include \"../lib' || ({t} % 9) || '/h' || ({t} % 200) || '.h\"' when 6 then '#include <h' || ({t} % 200) || '.h>' else '#include MACRO' end"
    ruby = f"case when {v} < 4 then 'require_relative \"y' || ({t} % 80) || '\"' when {v} = 4 then 'require \"json\"' when {v} = 5 then 'require \"rb/x' || ({t} % 6) || '/y' || ({t} % 80) || '\"' when {v} = 6 then 'require_relative(\"../x' || ({t} % 6) || '/y' || ({t} % 80) || '.rb\")' else 'load x' end"
    return f"case {k} % 8 when 0 then {python} when 1 then {python} when 2 then {script} when 3 then {go} when 4 then {java} when 5 then {rust} when 6 then {header} else {ruby} end"


def method_file(k: str) -> str:
    """The file of a method by its key: as path(), with C# in place of Ruby."""
    return f"case when {k} % 8 = 7 then 'cs/x' || ({k} % 6) || '/y' || ({k} % 400) || '.cs' else {path(k)} end"


def _number(k: str) -> str:
    """One of few names for half of the methods, one of many for the others."""
    return f"({k} % (40 + 1960 * (({k} div 8) % 2)))"


def method(k: str) -> str:
    """A method's full name as an analyzer of its language writes it."""
    return (
        f"case {k} % 8 when 0 then {path(k)} || ':<module>.C' || ({k} % 30) || '.m' || {_number(k)} when 1 then {path(k)} || ':<module>.m' || {_number(k)} when 2 then {path(k)} || '::program:m' || {_number(k)} "
        f"when 3 then 'acme.org/go/svc' || ({k} % 15) || '.m' || ({k} % 160) when 4 then 'com.acme.K' || ({k} % 300) || '.m' || {_number(k)} || ':void(int)' when 5 then 'rs' || ({k} % 12) || '.R' || ({k} % 50) || '.m' || {_number(k)} "
        f"when 6 then 'c' || ({k} % 600) else 'N.X' || ({k} % 90) || '.m' || {_number(k)} || ':void(N.T' || ({k} % 3) || ',System.Int32)' end"
    )


def called(k: str, t: str, v: str) -> str:
    """What a call in method k of method t is named, in the form v of seven."""
    special = (
        f"case {k} % 8 when 0 then '//pkg' || ({t} % 25) || '/mod' || ({t} % 60) || '.py:<module>.C' || ({t} % 30) || '.m' || {_number(t)} when 1 then 'C' || ({t} % 30) || '.m' || {_number(t)} when 2 then '../c' || ({t} % 20) || '/v' || ({t} % 90) || '.js::program:m' || {_number(t)} "
        f"when 3 then 'acme.org/go/svc' || ({t} % 15) || '.other' when 4 then 'K' || ({t} % 300) || '.m' || {_number(t)} || ':void(int)' when 5 then 'R' || ({t} % 50) || '.m' || {_number(t)} when 6 then 'a.c' || ({t} % 600) || '.c' || ({t} % 600) || ':int' else 'N.X' || ({t} % 90) || '.m' || {_number(t)} || ':void(T' || ({t} % 3) || ',Int32)' end"
    )
    member = (
        f"case {k} % 8 when 0 then 'os.py:<module>.join' when 1 then 'pkg' || ({t} % 25) || '.helper' when 2 then 'lodash:map' when 3 then 'ANY.f' || ({t} % 9) when 4 then case when {t} % 3 = 0 then 'Self.m' || {_number(t)} || ':void(int)' else 'K' || ({t} % 300) || '.absent' end when 5 then 'std.vec.push' "
        f"when 6 then 'c' || ({t} % 700) || ':void' else 'System.Console.Write:void(String)' end"
    )
    return f"case when {v} in (3, 4) then {method(t)} when {v} = 5 then {special} when {v} = 6 then {member} when {v} = 7 and {t} % 4 = 0 then '<unresolvedNamespace>.m' when {v} = 7 and {k} % 8 in (0, 1) then '' when {v} = 7 then 'lib.use' || ({t} % 5) else 'any' end"


def sites(k: str, s: str) -> dict[str, str]:
    """What an analyzer writes of a call in method k, in the form s of nine; the first six are no calls in most languages."""
    by = lambda *cases: "case " + " ".join(f"when {w} then {v}" for w, v in cases)
    lang = f"{k} % 8"
    return {
        "name": by((f"{s} = 0", "'<operator>.assignment'"), (f"{s} = 1", "'tmp' || ({k} % 5) || '.x'".replace("{k}", k)), (f"{s} = 3 and {lang} = 6", "'MAX'"), (f"{s} = 4 and {lang} = 6", "'int'"), (f"{s} = 4 and {lang} in (0, 1)", "'__iter__'"), (f"{s} in (3, 5) and {lang} = 2", "'require'"), (f"{s} = 3 and {lang} = 3", "'int32'"), (f"{s} = 4 and {lang} = 3", "''"), (f"{s} = 3 and {lang} = 4", "'<body>'")) + " else 'use' end",
        "code": by((f"{s} = 3 and {lang} in (0, 1)", "'enter_tmp3()'"), (f"{s} = 5 and {lang} in (0, 1)", "'deco(x)'"), (f"{s} = 4 and {lang} = 2", "'_iterator_2.next()'"), (f"{s} = 4 and {lang} = 3", "'[]byte(s)'"), (f"{s} = 5 and {lang} in (3, 6)", "'T{1}'")) + " else 'use()' end",
        "full": by((f"{s} = 2", "'ANY.ANY:x'"), (f"{s} = 4 and {lang} = 6", "'int.int:f'"), (f"{s} = 5 and {lang} = 6", "'struct.struct:S'"), (f"{s} = 4 and {lang} in (0, 1)", "'<unknownFullName>'"), (f"{s} = 4 and {lang} = 3", "'byte.'"), (f"{s} = 5 and {lang} = 3", "'T.<init>'")) + " else 'a.use' end",
        "caller": f"case when {s} = 5 and {lang} in (0, 1) then 'm.py:<module>' else 'f' end",
        "source_code": f"case when {s} = 3 and {lang} = 2 then 'import a from b' else '' end",
    }


def reason(k: str, s: str) -> str:
    """Why such a site is no call."""
    lang = f"{k} % 8"
    return (
        f"case when {s} = 0 then 'operator' when {s} in (1, 2) then 'synthetic' when {lang} = 6 and {s} = 3 then 'macro' when {lang} = 6 and {s} = 4 then 'type_conversion' when {lang} in (3, 6) and {s} = 5 then 'literal' "
        f"when {lang} in (0, 1) and {s} in (3, 4, 5) then 'synthetic' when {lang} = 2 and {s} = 3 then 'import_statement' when {lang} = 2 and {s} = 4 then 'synthetic' when {lang} = 3 and {s} in (3, 4) then 'type_conversion' when {lang} = 4 and {s} = 3 then 'synthetic' end"
    )
