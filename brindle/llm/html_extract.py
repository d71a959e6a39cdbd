"""Main text of web pages: markup, and how many pages of a host have a block.

Pages are cut into blocks.  Blocks that their markup calls menu, header, footer, sidebar, notice,
advert, form or comment are dropped; every other block, inside an article or main region or
not, is text unless it stands whole on many distinct pages of its host.  Blocks are compared
whole, by digest, and counted for each host: this stands in place of a suffix array, since a
paragraph is never cut and so a repeat decides only where it covers a whole block.  What is
repeated across differing block borders is therefore kept.

Pages with the same blocks count as one page, and so do pages with the same longest block if
it is long and few pages have it, so a copied article is not taken for a template.  A region
is evidence: blocks inside need half of the host's pages, others ``SHARE`` or ``MANY`` pages.

Every page is parsed once; blocks and digests are written for the steps after that.

Defined results: pages whose address is null or names no host are compared with no other; a
null or empty page has the empty text; malformed or cut-off markup closes
at the end; copies of a page on one host stay; repeated rows give repeated results; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, drop

#: Outside regions: so many distinct pages of the host, or so large a share of them (two at least).
MANY, SHARE = 10, 0.3
#: A block of so many words is long, and needs FEW pages anywhere; so does a block inside a region.
LONG, FEW, INSIDE_SHARE = 24, 5, 0.5
#: Attributes of a tag; a quoted value may hold a tag's end.
ATTRIBUTES = r"""(?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*')?|["'])*"""
#: A head may lack its end: the first element that it cannot hold ends it.
BODY = r"</head\s*>|(?=<body\b|</?(?!(?:base|link|meta|noscript|script|style|template|title)\b)[a-zA-Z])"
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)"
    r"|<(?P<head>head)\b[^>]*>(?:<!--.*?-->|<(?P<raw>script|style|noscript|template|title)\b.*?</(?P=raw)\s*>|(?!" + BODY + r").)*(?:</head\s*>)?"
    r"|<(title)\b.*?(?:</title\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<rest>" + ATTRIBUTES + r")(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)  # fmt: skip
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav footer aside form button select textarea menu dialog iframe object".split())
NOISE_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies dialog disclaimer footer header menu modal nav navbar navigation newsletter notice popup promo related search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Words that only tell where a part stands or what shape it has.
PLAIN_NAMES = frozenset("area article bar block body bottom box btn button buttons col column container content div entry fixed float global group head home icon icons inline inner item items label left link links list main media message messages meta mobile outer page panel post posts primary right row secondary section site slot sticky story tag tags text title top unit widgets wrap wrapper".split())
MAIN = frozenset(("article", "main"))
#: Names that inside an article say nothing: its own header, and works related to its matter.
OWN_NAMES = frozenset(("header", "related", "disclaimer", "search", "notice"))


def noisy(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in NOISE_TAGS or (tag == "header" and not in_main):
        return True
    if tag in MAIN or tag in ("html", "body") or not attributes:
        return False
    for m in NAME.finditer(attributes):
        for name in next(g for g in m.groups() if g is not None).lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()]
            # A name with a word that says something else ("has-sidebar", "social-policy") is no verdict.
            if (NOISE_NAMES - OWN_NAMES if in_main else NOISE_NAMES).intersection(words) and PLAIN_NAMES.union(NOISE_NAMES).issuperset(words):
                return True
    return False


def blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, in a main region, noise by markup) of each block with text, in page order."""
    out, text, stack, main, noise, at = [], [], [], 0, 0, 0

    def close():
        joined = " ".join("".join(text).split())
        if joined:
            out.append((joined, main > 0, noise > 0))
        text.clear()

    for m in TAG.finditer(page or ""):
        text.append(html.unescape(page[at : m.start()]))  # references end at tags
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        rest = m["rest"]
        if tag == "br":
            text.append(" ")
        if tag in INLINE or tag == "br":
            if not noisy(tag, rest, main > 0):
                continue
        if not m["close"]:
            close()
            if tag in VOID or rest.endswith("/"):
                continue
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                _, a, b = stack.pop()
                main, noise = main - a, noise - b
            mark = (tag, tag in MAIN, noisy(tag, rest, main > 0))
            stack.append(mark)
            main, noise = main + mark[1], noise + mark[2]
        else:
            close()
            if any(s[0] == tag for s in stack):
                while True:
                    name, a, b = stack.pop()
                    main, noise = main - a, noise - b
                    if name == tag:
                        break
    text.append(html.unescape((page or "")[at:]))
    close()
    return out


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def shown(page: str | None) -> tuple[list[str], list[bool], list[int], int]:
    """(texts, inside a region, digests) of the blocks that markup does not drop, and a digest of all."""
    import xxhash

    own = [(text, main) for text, main, noise in blocks(page) if not noise]
    digests = [int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True) for text, _ in own]
    whole = xxhash.xxh64_digest(b"".join(d.to_bytes(8, "big", signed=True) + bytes([main]) for d, (_, main) in zip(digests, own)))
    return [t for t, _ in own], [m for _, m in own], digests, int.from_bytes(whole, "big", signed=True)


def outlines(pages: DataFrame) -> DataFrame:
    """(id, url, host, whole, longest, blocks, texts): the blocks of each page with their digests; longest only if LONG."""
    block = pa.struct([("h", pa.int64()), ("inside", pa.bool_()), ("long", pa.bool_())])
    kept = pa.schema([("whole", pa.int64()), ("longest", pa.int64()), ("blocks", pa.list_(block)), ("texts", pa.list_(pa.string()))])

    def rows(it):
        for batch in it:
            step = max(1, min(512, (16 << 20) * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = {n: [] for n in kept.names}
                for source in part["html"].to_pylist():
                    texts, inside, digests, whole = shown(source)
                    words = [t.count(" ") + 1 for t in texts]
                    top = max(range(len(texts)), key=words.__getitem__, default=None)
                    out["whole"].append(whole)
                    out["longest"].append(digests[top] if top is not None and words[top] >= LONG else None)
                    out["blocks"].append([{"h": h, "inside": i, "long": n >= LONG} for h, i, n in zip(digests, inside, words)])
                    out["texts"].append(texts)
                columns = [part[n] for n in ("id", "url", "host")] + [pa.array(out[f.name], f.type) for f in kept]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "host", *kept.names])

    kinds = dict(pages.dtypes)
    return pages.select("id", "url", "host", "html").mapInArrow(rows, f"id {kinds['id']}, url {kinds['url']}, host string, whole long, longest long, blocks array<struct<h:long,inside:boolean,long:boolean>>, texts array<string>")


def repeated(found: DataFrame) -> DataFrame:
    """(host, whole, runs array<int>): positions of the blocks that are boilerplate."""
    kinds = found.select("host", "whole", "longest").distinct()
    bodies = kinds.where("longest IS NOT NULL").groupBy("host", "longest").agg(F.count("*").alias("n")).where(F.col("n").between(2, FEW - 1))
    bodies = bodies.select(F.col("host").alias("bh"), F.col("longest").alias("bl"))
    # Copies of one body are one page.
    kinds = kinds.join(bodies, (F.col("host") == F.col("bh")) & (F.col("longest") == F.col("bl")), "left")
    kinds = cut(kinds.select("host", "whole", F.coalesce("bl", "whole").alias("body")), "kinds")
    hosts = kinds.groupBy("host").agg(F.countDistinct("body").alias("pages"))
    placed = found.dropDuplicates(["host", "whole"]).select("host", "whole", F.posexplode("blocks").alias("at", "b")).select("host", "whole", "at", "b.*")
    placed = cut(placed, "blocks")
    counts = placed.select("host", "whole", "h", "long").distinct().join(kinds, ["host", "whole"]).select("host", "h", "long", "body").distinct()
    counts = counts.groupBy("host", "h", "long").agg(F.count("*").alias("n")).where("n > 1").join(hosts, "host")
    often = counts.where((F.col("n") >= MANY) | (F.col("n") >= SHARE * F.col("pages"))).where(~F.col("long") | (F.col("n") >= FEW))
    often = cut(often.select("host", "h", ((F.col("n") >= FEW) & (F.col("n") >= INSIDE_SHARE * F.col("pages"))).alias("anywhere")), "often")
    runs = cut(placed.join(often, ["host", "h"]).where("anywhere OR NOT inside").groupBy("host", "whole").agg(F.collect_set("at").alias("runs")), "runs")
    drop(kinds, placed, often)
    return runs


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars)"""
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    parsed = cut(outlines(src), "outlines")
    named = parsed.select("host", "whole", "longest", "blocks").where("host != ''")
    runs = repeated(named).select(F.col("host").alias("rh"), F.col("whole").alias("rw"), "runs")
    both = parsed.join(runs, (F.col("host") == F.col("rh")) & (F.col("whole") == F.col("rw")), "left")
    text = F.array_join(F.when(F.col("runs").isNull(), F.col("texts")).otherwise(F.filter("texts", lambda t, k: ~F.array_contains("runs", k))), " ")
    return both.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
