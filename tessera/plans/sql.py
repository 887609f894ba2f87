"""The text functions as SQL expressions, for checks against another engine."""

from __future__ import annotations

from tessera.functions.lexicon import Lexicon
from tessera.functions.text import DATE, ENDS, SPACES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def plain(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]*>', ' ', 'g'), {q('[' + SPACES + ']+')}, ' ', 'g'))"


def parts(text: str) -> str:
    return f"string_split(regexp_replace({text}, {q('([' + ENDS + '])')}, '\\1' || chr(1), 'g'), chr(1))"


def paragraphs(html: str, text: str) -> str:
    tags = f"len(regexp_extract_all(coalesce({html}, ''), {q('(?i)<p[' + SPACES + '>]')}))"
    return f"CASE WHEN {tags} > 0 THEN {tags} ELSE len(list_filter({parts(text)}, lambda s: length(trim(s)) >= 30)) END"


def tier(content: str, html: str) -> str:
    t = plain(content)
    return f"CASE WHEN length({t}) >= 300 OR (length({t}) >= 150 AND length(coalesce({html}, '')) >= 300 AND {paragraphs(html, t)} >= 1) THEN 'full' WHEN length({t}) >= 80 THEN 'summary' ELSE 'external' END"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join([f"contains({text}, {q(w)})" for w in words] or ["false"]) + ")"


def count_of(text: str, words) -> str:
    return "(" + " + ".join([f"contains({text}, {q(w)})::INT" for w in words] or ["0"]) + ")"


def like(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def topic(text: str, lex: Lexicon) -> str:
    return "(" + " OR ".join([any_of(text, lex.core), *[f"({like(text, a)} AND {like(text, b)})" for a, b in lex.pairs]]) + ")"


def candidate(text: str, lex: Lexicon) -> str:
    return f"({topic(text, lex)} OR {any_of(text, lex.candidate)})"


def score(text: str, lex: Lexicon) -> str:
    return f"({count_of(text, lex.strong)} * 2 + {count_of(text, lex.weak)})"


def exclusion(title: str, url: str, lex: Lexicon) -> str:
    bad = f"{title} IS NULL OR trim({title}) = '' OR contains({title}, chr(65533)) OR {like(title, '[?]{3}')}"
    return (
        f"CASE WHEN {bad} THEN 'malformed_title' WHEN {like(title, lex.site_noise)} OR {like(title, lex.noise_title)} THEN 'site_noise' "
        f"WHEN {like(title, lex.training_title)} THEN 'training' WHEN {like(f'coalesce({url}, {q("")})', lex.training_url)} THEN 'training_url' END"
    )


def normalized(title: str) -> str:
    return f"regexp_replace(regexp_replace(lower(coalesce({title}, '')), {q(DATE)}, '', 'g'), {q('[' + SPACES + r'\p{P}\p{S}]+')}, '', 'g')"


def title_pairs(rows: str, least: float) -> str:
    """Common table expressions up to ``pair`` (a, b, similarity) over ``rows`` (id, title)."""
    return f"""
nt AS (SELECT id, {normalized('title')} AS t FROM {rows}),
bg AS (SELECT DISTINCT id, g FROM (SELECT id, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS g FROM nt WHERE length(t) >= 2)),
bn AS (SELECT id, count(*) AS n FROM bg GROUP BY id),
bo AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM bg x JOIN bg y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
pair AS (SELECT a, b, k / (x.n + y.n - k) AS similarity FROM bo JOIN bn x ON x.id = a JOIN bn y ON y.id = b WHERE k / (x.n + y.n - k) >= {least})"""


def cut_at_end(text: str, most: int, beyond: float, index: bool = False) -> str:
    head = f"left({text}, {most})"
    cut = f"regexp_extract({head}, {q('(?s)^(.*[' + ENDS + '])')}, 1)"
    return f"CASE WHEN length({cut}){' - 1' if index else ''} > {beyond} THEN {cut} ELSE {head} END"
