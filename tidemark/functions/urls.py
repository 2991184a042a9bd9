"""Urls of content items: canonical forms and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track where a reader came from. Fixed values.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_referrer",
    "fbclid", "gclid", "msclkid", "yclid", "dclid", "ref", "ref_src", "ref_url", "source", "from", "spm",
]

#: Hosts by the platform they belong to, with what may stand before them, and the first path part before a video's number.
POST_HOSTS, VIDEO_HOST, SHORT_VIDEO_HOST = ("twitter.com", "x.com"), "youtube.com", "youtu.be"
HOST_PREFIXES = ("www.", "m.", "mobile.")
VIDEO_FOLDERS = ("shorts", "embed", "live")
VIDEO_LETTERS = 11


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, tracking parameters and fragment off; null unless scheme and host are there."""
    url = F.trim(url)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, path, tail))


def url_parts(url: Column) -> Column:
    """Struct (site, path, params): the host in lower case without port and common prefixes, the parts of the path, and the
    parameters of the query as they stand. A scheme may be missing."""
    rest = F.substring_index(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#", 1)
    pieces = F.split(F.substring_index(rest, "?", 1), "/")
    site = F.lower(F.substring_index(F.get(pieces, F.lit(0)), ":", 1))
    for prefix in HOST_PREFIXES:
        site = F.when(site.startswith(prefix), F.substr(site, F.lit(len(prefix) + 1))).otherwise(site)
    query = F.when(F.instr(rest, "?") > 0, F.substr(rest, F.instr(rest, "?") + 1)).otherwise("")
    return F.struct(site.alias("site"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("path"), F.split(query, "&").alias("params"))


def post_number(parts: Column) -> Column:
    """The number of a post under /<user>/status/<number>, null elsewhere."""
    digits = F.regexp_extract(F.get(parts["path"], F.lit(2)), "^[0-9]+", 0)
    return F.when(parts["site"].isin(*POST_HOSTS) & (F.lower(F.get(parts["path"], F.lit(1))) == "status") & (F.get(parts["path"], F.lit(0)) != ""), F.nullif(digits, F.lit("")))


def video_number(parts: Column) -> Column:
    """The number of a video: the parameter v of /watch, the part behind a video folder, or a short link's only part."""
    head, second = F.get(parts["path"], F.lit(0)), F.get(parts["path"], F.lit(1))
    v = F.get(F.filter(parts["params"], lambda p: p.startswith("v=")), F.lit(0))
    said = (
        F.when(parts["site"] == SHORT_VIDEO_HOST, head)
        .when((parts["site"] == VIDEO_HOST) & (F.lower(head) == "watch"), F.substr(v, F.lit(3)))
        .when((parts["site"] == VIDEO_HOST) & F.lower(head).isin(*VIDEO_FOLDERS), second)
    )
    number = F.substring(said, 1, VIDEO_LETTERS)
    return F.when((F.char_length(number) == VIDEO_LETTERS) & (F.translate(number, "-_", "ab").rlike("^[A-Za-z0-9]+$")), number)


def url_identity(url: Column) -> Column:
    """Struct (platform, item_id, canonical): posts and videos by their number, all else by an md5 of the url."""
    url = F.trim(F.coalesce(url, F.lit("")))
    parts = url_parts(url)
    post, video, user = post_number(parts), video_number(parts), F.get(parts["path"], F.lit(0))
    make = lambda platform, item, canonical: F.struct(F.lit(platform).alias("platform"), item.alias("item_id"), canonical.alias("canonical"))
    return (
        F.when(post.isNotNull(), make("twitter", post, F.concat(F.lit("https://x.com/"), user, F.lit("/status/"), post)))
        .when(video.isNotNull(), make("youtube", F.concat(F.lit("yt_"), video), F.concat(F.lit("https://www.youtube.com/watch?v="), video)))
        .otherwise(make("manual", F.md5(url), url))
    )


def source_identity(url: Column, item_id: Column) -> Column:
    """Papers by arXiv number, repositories by owner and name, then canonical url, raw url, id."""
    paper = F.regexp_extract(url, r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})", 1)
    owner, name = (F.lower(F.regexp_extract(url, r"(?i)github\.com/([^/?#]+)/([^/?#]+)", k)) for k in (1, 2))
    return F.coalesce(
        F.when(paper != "", F.concat(F.lit("arxiv:"), paper)),
        F.when(owner != "", F.concat(F.lit("github:"), owner, F.lit("/"), F.regexp_replace(name, r"\.git$", ""))),
        canonical_url(url), F.nullif(F.trim(url), F.lit("")), item_id,
    )
