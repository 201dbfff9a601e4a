"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens (runs of a-z and 0-9) that any url it matches must hold
as whole tokens. Hosts are in lower case; in paths, A-Z ends a token, as it does for the rules' expressions. How often each rule token occurs is counted over all urls; every rule is filed under its
rarest one. A url is cut into tokens, these fetch the candidate rules, and only those run their expression.
Rules without a token are always candidates. Of the rules that match, those of the lowest layer decide, of these the
longest text, then the first.

Rules are written as patterns (see parse): anchors, wildcards, separators and exceptions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, values

TOKEN = r"[a-z0-9]+"
_URL = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(65, 91)}
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    text: str  # what is reported
    verdict: str  # allow or block
    regex: str  # searched in host + path
    tokens: tuple[str, ...]  # each is a whole token of every match
    layer: int = 0  # rules of the lowest layer that match decide


def host_path(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with all its subdomains and the paths that start with path.

    The last token of the path may go on in the url (/en/7 fits /en/71), so it is not indexed unless a sign
    follows it.
    """
    if not path.startswith("/"):
        raise ValueError("a rule's path starts with /")
    tokens = re.findall(TOKEN, host) + re.findall(TOKEN + r"(?=[^a-z0-9])", path) * path.islower()
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens))


def word(token: str, verdict: str = "block") -> Rule:
    """A rule for a whole path token anywhere in the path."""
    return Rule(token, verdict, rf"/(?:[^/]*[^a-z0-9/])?{re.escape(token)}(?![a-z0-9])", (token,), 2)


_PART = re.compile(r"[a-z0-9]+|\*+|\^|[^a-z0-9*^]", re.S)
_SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\Z)"


def parse(line: str) -> Rule | None:
    """The rule that a line stands for; None for empty lines and remarks, which start with !.

    A pattern is found anywhere in host + path. || at its start: at the beginning of the host or of one of its
    labels; | at its start or end: at the beginning or end of the address; * is any text, ^ a separator (no letter,
    digit or _ . % -) or the end. Lines that start with @@ are exceptions, which allow and come before all that block.
    Literal tokens count if something in the pattern ends them on both sides.
    """
    text = line.strip()
    if not text or text.startswith("!"):
        return None
    exception, body = text.startswith("@@"), text.removeprefix("@@")
    label, begin = body.startswith("||"), body.startswith("|")
    body = body[2 * label or begin :]
    end = body.endswith("|")
    parts = _PART.findall(body[: len(body) - end])
    regex = ("^(?:[^/]*\\.)?" if label else "^" if begin else "") + "".join(".*" if x[0] == "*" else _SEPARATOR if x == "^" else re.escape(x) for x in parts) + r"\Z" * end
    left, right = ["" if begin else "*", *parts], [*parts, "" if end else "*"]
    tokens = [x for k, x in enumerate(parts) if re.fullmatch(TOKEN, x) and not left[k].startswith("*") and not right[k + 1].startswith("*")]
    return Rule(text, "allow" if exception else "block", regex, tuple(tokens), 1 if exception else 2)


def read_rules(lines: Iterable[str]) -> list[Rule]:
    return [r for r in map(parse, lines) if r is not None]


#: What pages are judged by. Layer 0 comes first; then exceptions; where none of these fits, the rest decides.
HOST_RULES = [host_path("com", "/en/", "block"), host_path("example.com", "/en/7", "allow"), host_path("net", "/de/", "allow"), host_path("example.net", "/de/8", "block"), host_path("org", "/es/", "block")]
WORDS = ("ads", "advert", "banner", "popup", "tracker", "tracking", "affiliate", "sponsor", "login", "signup", "cart", "checkout")
PATH_RULES = [word(t) for t in WORDS]
_PLACES = ("js", "img", "static", "media", "content", "assets", "widget", "lib", "cdn", "api", "news", "shop")
_FORMS = ("||{w}.{p}.*^", "/{p}/{w}_*", "/{p}/*/{w}^", "||{p}-{w}.", "/{p}.{w}.js|", "/{w}/{p}^*.gif|", "||{w}{n}.{p}.com^", "/{p}{n}/{w}^", "_{w}_{p}^", "|{w}.{p}.", "@@||{p}.example.org/{w}^", "@@/{p}/{w}/help|")
#: Patterns made from the words, places and forms, each with a number.
PATTERN_RULES = read_rules(form.format(w=w, p=p, n=n) for n, (form, p, w) in enumerate(product(_FORMS, _PLACES, WORDS)))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """host, path, rule (of layer 0, else null) and verdict of every url.

    Host: what follows the first :// up to /, ?, # or the end, with A-Z in lower case; path: then up to ? or #.
    Null urls and those without :// have both empty, and no rule fits them but one without any text; they get
    the default. A row for each row; null ids stay null; repeated rows come out repeated; other columns are not
    looked at; an empty table gives an empty table.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    known = sorted({t for r in rules for t in r.tokens})
    host, path = (F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", k) for k in (1, 2))
    address = F.concat(F.translate(host, _UPPER, _SMALL), path)
    tokens = pages.select(F.explode(F.array_distinct(F.split(address, "[^a-z0-9]+"))).alias("t"))  # a url's tokens, each once
    of_rules = F.broadcast(pages.sparkSession.createDataFrame([(t,) for t in known], "t string"))  # as many as the rules have
    often = {r.t: r.n for r in tokens.join(of_rules, "t", "left_semi").groupBy("t").agg(F.count("*").alias("n")).collect()}

    index: dict[str, list[int]] = {}
    always: list[int] = []
    for k, r in enumerate(rules):
        if r.tokens:
            index.setdefault(min(r.tokens, key=lambda t: (often.get(t, 0), t)), []).append(k)
        else:
            always.append(k)
    texts = [(r.regex, r.text, r.verdict, r.layer) for r in rules]

    def run(batches):
        compiled, cut = {}, re.compile(TOKEN)

        def fits(k: int, whole: str) -> bool:
            if k not in compiled:
                compiled[k] = re.compile(texts[k][0], re.S)
            return compiled[k].search(whole) is not None

        for part in slices(batches, "u"):
            out = []
            for url in values(part, "u").to_pylist():
                m = _URL.match(url or "")
                host, path = (m[1].translate(_LOWER), m[2]) if m else ("", "")
                whole = host + path
                tried = always + [k for t in set(cut.findall(whole)) if t in index for k in index[t]]
                hits = [k for k in tried if fits(k, whole)]
                best = min(hits, key=lambda k: (texts[k][3], -len(texts[k][1]), k), default=None)
                out.append((host, path, texts[best][1] if best is not None and not texts[best][3] else None, default if best is None else texts[best][2]))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([values(part, "i"), *[pa.array(c, pa.string()) for c in cols]], names=[id_col, "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u")).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
