"""Main text of web pages by equivalence-class template deduction.

1. Each page becomes tokens: its elements, as paths from the root that carry tag, class
   and id, and its text blocks, as the path and the text. A token's occurrence vector
   over the pages of its host is kept as a fingerprint: the xor of a hash of (page, count)
   over all pages, added up per task before the shuffle. Pages of a host with the same
   text are one page here, so copies do not make their text a template.
2. Tokens of one host with equal vectors are an equivalence class. Template tokens stand
   once on each page that has them; repeated elements lie between them. The class of what
   stands on every page is the root. Another class is valid if it has CLASS_SIZE tokens
   and stands on two pages and SUPPORT of all, and if it nests: its outermost tokens lie
   in one element, or in elements of one class.
3. Template elements are the bounds of slots. A slot holds the data of a host if SLOT_SHARE
   of the text that is no template's, and no link, lies in it; of these, the deepest that
   a page has is the page's slot, and all its text is extracted, that which all pages
   share too. Where nothing differs between the pages of a host, all text counts.
   An article or main element around the slot belongs to it, and one inside it bounds it.

Names only exclude: elements whose tag, role, class or id says menu, header, footer,
sidebar, notice, advert, form or comments give no tokens and no text. Nothing depends on
how many pages a host has.

Null html is empty; an empty page, or one without main text, gives the empty string. A
null or unusual url is a host like any other. Every repeated page gets its text. Unclosed
and misnested tags close as browsers close them. Very long pages are read whole. Other
columns do not matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_SHARE, spread_join, table, work_dir, worker_cache, written

#: Tokens and share of a host's pages that make a class valid beside the root; share of the varying text that makes a slot.
CLASS_SIZE, SUPPORT, SLOT_SHARE = 3, 0.1, 0.9
#: Total bytes of hot hosts' templates up to which they are broadcast; a merge join beyond.
BROADCAST_BYTES = 32 << 20
#: Host of a url: what stands between scheme and user and the path.
HOST = r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#]*)"

# Names of HTML elements and usual words in class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Start tag -> (open elements that it ends, elements beyond which it does not look).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
LEFT_OUT = frozenset("nav footer aside form button select dialog menu noscript template svg math canvas object video audio map datalist".split())
MAIN = frozenset(("article", "main"))
LEFT_OUT_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner alert aside breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
LEFT_OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Parts of class names and ids that say the same wherever they stand.
LEFT_OUT_PARTS = re.compile("sidebar|comment|advert|cookie|newsletter|breadcrumb|footer|navbar|disqus|discussion|reactions")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|iframe|noembed|noframes|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|</?[a-zA-Z](?:[^"'>]|"[^"]*"|'[^']*')*+>|</?[a-zA-Z][^>]*>|<[!?][^>]*>|</[^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\s(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>])""", re.IGNORECASE)


def _described(tag: str) -> tuple[str, str, bool, bool, bool]:
    """Of a start tag: name, key, whether it is left out, is an article or main element, is a header.

    Headers are left out where no article or main element is around them.
    """
    name = _NAME.match(tag)[1].lower()
    if name == "a" or len(tag) == len(name) + 2:
        return name, name, name in LEFT_OUT, name in MAIN, name == "header"
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(tag)}
    named = re.sub(r"\d+", "#", f"{found.get('class', '')}.{found.get('id', '')}".lower())
    role = found.get("role", "").lower()
    words = set(re.split(r"[\s_.#-]+", named)) if name not in ("html", "body") else set()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    out = hidden or role in LEFT_OUT_ROLES or name in LEFT_OUT
    if name not in MAIN and words:
        out = out or bool(words & LEFT_OUT_WORDS or LEFT_OUT_PARTS.search(named))
    main = not out and (name in MAIN or role in ("main", "article"))
    return name, f"{name}.{named}" if named != "." else name, out, main, name == "header" or bool(words & HEADER_WORDS)


class Parser:
    """page -> text blocks and block elements, with paths; keeps descriptions of tags and paths."""

    def __init__(self):
        self.tags: dict[str, tuple] = {}
        self.paths: dict[tuple[int, str], int] = {}

    def _path(self, parent: int, key: str) -> int:
        if (found := self.paths.get((parent, key))) is None:
            if len(self.paths) > 200_000:
                self.paths.clear()
            found = self.paths[parent, key] = xxhash.xxh64_intdigest(f"{parent} {key}") >> 1
        return found

    def parse(self, page: str | None) -> tuple[list[tuple], dict[int, list]]:
        """Blocks (path, ancestors, in main, text, plain characters) and elements path -> [count, ancestors, whether it holds elements, plain characters].

        Plain characters are those outside links. What is left out by its role gives neither.
        """
        blocks: list[tuple] = []
        elements: dict[int, list] = {}
        #: name, path, left out, main, inline
        stack: list[tuple] = [("", 0, False, False, False)]
        parts: list[str] = []
        linked, in_link, page = 0, 0, page or ""

        def flush():
            nonlocal linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    k = len(stack) - 1
                    while stack[k][4]:
                        k -= 1
                    above = [x[1] for x in stack[1 : k + 1] if not x[4]]
                    plain = max(0, len(text) - linked)
                    for path in above:
                        elements[path][3] += plain
                    blocks.append((stack[k][1], above, stack[k][3], text, plain))
            linked = 0

        def pop(k: int):
            nonlocal in_link
            if any(not x[4] for x in stack[k:]):
                flush()
            in_link -= sum(x[0] == "a" for x in stack[k:])
            del stack[k:]

        at = 0
        for m in _TOKEN.finditer(page):
            start, end = m.span()
            if start > at and not stack[-1][2]:
                text = page[at:start]
                parts.append(text)
                if in_link:
                    linked += len(text)
            at = end
            tag = m.group()
            if m.group(1) or tag[1] in "!?":
                continue
            if tag[1] == "/":
                name = _NAME.match(tag)
                name = name[1].lower() if name else ""
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        pop(k)
                        break
                continue
            if (found := self.tags.get(tag)) is None:
                if len(self.tags) > 50_000:
                    self.tags.clear()
                found = self.tags[tag] = _described(tag)
            name, key, out, main, header = found
            if name in VOID:
                if name == "br":
                    parts.append(" ")
                elif name == "hr":
                    flush()
                continue
            inline = name in INLINE
            if not inline:
                flush()
                ends, stop = ENDS.get(name, ((), ()))
                if name in CLOSES_P:
                    ends, stop = {"p"}, {"td", "th", "button", "li", "table"} if name != "p" else {"td", "th", "button", "table"}
                k = first = len(stack)
                while k > 1 and stack[k - 1][0] not in stop and ends:
                    k -= 1
                    if stack[k][0] in ends:
                        first = k
                if first < len(stack):
                    pop(first)
            _, path, was_out, was_main, _ = stack[-1]
            main = main or was_main
            out = out or was_out or header and not main
            if not inline:
                path = self._path(path, key)
                if not out:
                    k = len(stack) - 1
                    while stack[k][4]:
                        k -= 1
                    above = stack[k][1]
                    if above:
                        elements[above][2] = True
                    elements.setdefault(path, [0, above, False, 0])[0] += 1
            in_link += name == "a"
            stack.append((name, path, out, main, inline))
        if at < len(page) and not stack[-1][2]:
            parts.append(page[at:])
        flush()
        return blocks, elements


def _text_token(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{text}") >> 1


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> host, hash of the page's text, its plain characters, elements and text tokens with their counts.

    The parent of a token is the nearest element around it that stands once on the page.
    """
    worker_cache("html_extract")
    parser = Parser()
    for whole in batches:
        for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
            same, found = [], []
            for page in batch.column(1).to_pylist():
                blocks, elements = parser.parse(page)
                h, texts = xxhash.xxh3_128(), {}

                def around(path: int) -> int:
                    while path and elements[path][0] > 1:
                        path = elements[path][1]
                    return path

                for path, _, _, text, plain in blocks:
                    h.update(f"{path}\n{text}\n\n".encode("utf-8", "surrogatepass"))
                    t = texts.setdefault(_text_token(path, text), [0, around(path), plain])
                    t[0] += 1
                x = array("q", [sum(b[4] for b in blocks), len(elements)])
                for path, (count, parent, holds, plain) in elements.items():
                    x.extend((path, count, around(parent), holds, plain))
                for token, (count, parent, plain) in texts.items():
                    x.extend((token, count, parent, plain))
                same.append(h.digest())
                found.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(found, pa.binary())], names=["host", "same", "found"])


TOKENS = "host string, token long, kind int, pages long, occurrences long, vector long, parent long, holds boolean, plain long, of_plain long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages -> per host and token: kind (0: the page, 1: element, 2: text), pages, occurrences, vector, parent, whether it holds elements, plain characters in it and on its pages."""
    seen: dict[tuple[str, int], list] = {}
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]

    def flush():
        rows = [(h, t, *v) for (h, t), v in seen.items()]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in TOKENS.split(", ")])

    def add(host, same, token, kind, count, parent, holds, plain, of_plain):
        vector = xxhash.xxh64_intdigest(same, count & 0xFFFFFFFF) >> 1
        if (v := seen.get((host, token))) is None:
            seen[host, token] = [kind, 1, count, vector, parent, holds, plain, of_plain]
        else:
            v[1] += 1
            v[2] += count
            v[3] ^= vector
            v[4] = min(v[4], parent)
            v[5] |= holds
            v[6] += plain
            v[7] += of_plain

    for batch in batches:
        for host, same, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            x = array("q", found)
            add(host, same, 0, 0, 1, 0, True, x[0], x[0])  # the page itself, whose vector is that of the root class
            end = 2 + 5 * x[1]
            for i in range(2, end, 5):
                path, count, parent, holds, plain = x[i : i + 5]
                add(host, same, path, 1, count, parent, bool(holds), plain, x[0])
            for i in range(end, len(x), 4):
                token, count, parent, plain = x[i : i + 4]
                add(host, same, token, 2, count, parent, False, plain, x[0])
        if len(seen) > 200_000:
            yield flush()
    yield flush()


def vectors(pages: DataFrame) -> DataFrame:
    """The tokens of each host (host, html) with their vectors, and of_pages and root_vector of the host."""
    folder = work_dir(pages.sparkSession)
    apart = pages.select("host", "html").mapInArrow(_pages, "host string, same binary, found binary").groupBy("host", "same").agg(F.min("found").alias("found"))
    tokens = apart.mapInArrow(_tokens, TOKENS)
    sums = {c: F.sum(c).alias(c) for c in ("pages", "occurrences", "plain", "of_plain")}
    tokens = tokens.groupBy("host", "token", "kind").agg(sums["pages"], sums["occurrences"], F.bit_xor("vector").alias("vector"), F.min("parent").alias("parent"), F.bool_or("holds").alias("holds"), sums["plain"], sums["of_plain"])
    # text of one page is no template's, or that of a host without differences
    tokens = written(tokens.filter("kind < 2 or pages > 1"), "tokens", folder)
    of_page = lambda c: F.max(F.when(F.col("kind") == 0, F.col(c)))
    hosts = written(tokens.groupBy("host").agg(of_page("pages").alias("of_pages"), of_page("vector").alias("root_vector"), F.count("*").alias("_tokens")), "hosts", folder)
    return spread_join(tokens, hosts, ["host"], "_tokens", hosts.agg(F.sum("_tokens")).first()[0] or 0)


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the classes of each host that are large and frequent enough, as JSON."""
    once = vectors(pages).filter("kind > 0 and occurrences = pages")
    of_class = once.groupBy("host", "vector").agg(F.count("*").alias("size"), F.min(F.col("vector") == F.col("root_vector")).alias("root"), F.collect_list(F.struct("kind", F.col("token").alias("t"), F.col("parent").alias("p"), "holds", "plain", "of_plain", "pages")).alias("tokens"), F.min("pages").alias("on"), F.min("of_pages").alias("of"))
    valid = of_class.filter(F.col("root") | ((F.col("size") >= CLASS_SIZE) & (F.col("on") >= 2) & (F.col("on") >= SUPPORT * F.col("of"))))
    made = valid.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct((~F.col("root")).alias("inner"), F.col("vector").alias("v"), F.sort_array("tokens").alias("tokens"))))).alias("template"))
    return made


class Template:
    """The classes of a host, nested, and the elements that bound its slots of data."""

    def __init__(self, made: str | None):
        classes = json.loads(made) if made else []
        of: dict[int, int] = {}  # token -> number of its class; the root is 0
        for k, c in enumerate(classes):
            of |= {x["t"]: k for x in c["tokens"]}
        #: class -> class it nests in, for valid classes
        self.nested: dict[int, int] = {}
        for k, c in enumerate(classes):
            around = {x["p"] for x in c["tokens"] if of.get(x["p"]) != k}
            if k == 0 and not c["inner"] or len(around) <= 1 or len({of.get(p, -1) for p in around}) == 1 and -1 not in {of.get(p, -1) for p in around}:
                self.nested[k] = of.get(min(around, default=0), 0)
        shared, below = 0, defaultdict(int)  # template text of the root class, in all and in each element
        if classes and not classes[0]["inner"]:
            parent = {x["t"]: x["p"] for x in classes[0]["tokens"]}
            for x in classes[0]["tokens"]:
                if x["kind"] == 2:
                    each = x["plain"] // x["pages"]
                    shared += each
                    path, met = x["p"], set()
                    while path and path not in met:
                        met.add(path)
                        below[path] += each
                        path = parent.get(path, 0)
        #: elements that hold the data of the host
        self.slots = set()
        for k, c in enumerate(classes):
            for x in c["tokens"] if k in self.nested else ():
                if x["kind"] == 1 and x["holds"]:
                    own, every = x["plain"] - below[x["t"]] * x["pages"], x["of_plain"] - shared * x["pages"]
                    if every <= 0:  # nothing differs
                        own, every = x["plain"], x["of_plain"]
                    if own >= SLOT_SHARE * every and every > 0:
                        self.slots.add(x["t"])

    def extract(self, blocks: list[tuple]) -> str:
        deepest, slot = -1, None
        for _, above, *_ in blocks:
            for depth in range(len(above) - 1, deepest, -1):
                if above[depth] in self.slots:
                    deepest, slot = depth, above[depth]
                    break
        inside = [b for b in blocks if slot is None or slot in b[1][deepest : deepest + 1]]
        if any(b[2] for b in inside):
            inside = [b for b in blocks if b[2]]
        return "\n\n".join(b[3] for b in inside)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("html_extract")
    parser = Parser()
    made: dict[str, Template] = {}
    for batch in batches:
        texts = []
        for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (t := made.get(template or "")) is None:
                if len(made) > 500:
                    made.clear()
                t = made[template or ""] = Template(template)
            texts.append(t.extract(parser.parse(page)[0]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page (page_id, url, html)."""
    host = F.regexp_extract(F.lower(F.trim(F.coalesce(F.col("url").cast("string"), F.lit("")))), HOST, 1)
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    found = written(templates(pages).join(pages.groupBy("host").agg(F.count("*").alias("_pages")), "host", "right"), "templates")
    total = found.agg(F.sum("_pages")).first()[0] or 0
    hot = found.filter(F.col("_pages") > total * HOT_SHARE).agg(F.sum(F.length("template"))).first()[0] or 0
    both = spread_join(pages, found, ["host"], "_pages", total) if hot <= BROADCAST_BYTES else pages.join(found.hint("merge"), "host")
    both = both.select("page_id", "url", "html", "template")
    return both.mapInArrow(_extracted, T.StructType([pages.schema["page_id"], pages.schema["url"], *T.StructType.fromDDL("text string, n_chars long").fields]))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
