"""What a home page says about its site: contact, pages by kind, repository, roles, and whether it is parked (E-11, E-12).

One pass reads a page's links (resolved against the site's address), its visible text and its short pieces of text;
all rules are expressions over these. Links stay in page order, so every preference is stable.
"""

from __future__ import annotations

import urllib.parse
from functools import reduce
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import host, is_profile, registrable
from lodestone.sources.html import VOID, flat

# Word lists. A path has a word if it stands between slashes, dots, hyphens or underscores.
PATH_WORDS = {
    "careers": "career careers job jobs join-us joinus join-our-team work-with-us workwithus openings vacancy vacancies hiring opportunities",
    "team": "team our-team the-team meet-the-team people leadership founders management advisor advisors",
    "about": "about about-us aboutus who-we-are our-story company",
    "products": "product products solution solutions platform offering offerings",
    "technology": "technology technologies tech research science innovation how-it-works",
}
LINK_WORDS = {
    "careers": "career|careers|jobs|join us|join our team|work with us|we're hiring|openings",
    "team": "team|our team|the team|meet the team|people|leadership|founders|management",
    "about": "about|about us|who we are|our story|company",
    "products": "product|products|our product|our products|solution|solutions|platform|offering|offerings",
    "technology": "technology|technologies|our technology|our technologies|research|science|innovation|how it works",
}
CONTACT_WORDS, CONTACT_LINKS = "contact contacts contact-us contactus contacts-us get-in-touch getintouch reach-us reachus", "contact|contacts|contact us|contacts us|get in touch|reach us"
HIRING_HOSTS = "lever.co greenhouse.io keka.com zohorecruit.com zohorecruit.in workable.com darwinbox.in freshteam.com recruitee.com breezy.hr smartrecruiters.com ashbyhq.com wellfound.com angel.co instahyre.com cutshort.io naukri.com internshala.com bamboohr.com jobvite.com teamtailor.com"
CODE_HOSTS = "github.com gitlab.com bitbucket.org huggingface.co"
NO_ACCOUNT = "sponsors login join features about pricing topics marketplace explore orgs users site settings apps enterprise security"
MAIL_HOSTS = "gmail.com googlemail.com yahoo.com yahoo.co.in yahoo.in ymail.com rediffmail.com outlook.com hotmail.com live.com msn.com icloud.com me.com aol.com proton.me protonmail.com zoho.com zohomail.in gmx.com mail.com yandex.com example.com domain.com yourdomain.com email.com wix.com wixpress.com sentry.io sentry-next.wixpress.com godaddy.com squarespace.com"
MAILBOXES = "info contact contactus hello sales business enquiry enquiries inquiry inquiries connect support office admin team mail"
NO_MAILBOX = "noreply no-reply donotreply do-not-reply mailer-daemon postmaster example test user name yourname your-name you email someone username abuse webmaster wordpress"
OTHER_MAILBOX = ("career", "humancapital", "recruit", "hiring", "talent", "resume", "privacy", "grievance", "legal")
OTHER_MAILBOX_WHOLE = "hr cv dpo human.resources human-resources humanresources"
JOB_PARTS, JOB_WORDS = ("career", "hiring", "vacanc", "recruit"), "job jobs join-us joinus"
ROLE_LEADS = "application apply position role job"
PARKED = ("domain for sale", "domain is for sale", "domain may be for sale", "domain parked", "domain is parked", "buy this domain", "this domain name", "parkingcrew", "sedoparking", "hugedomains", "coming soon", "under construction", "website is coming")
NO_OPENINGS = ("no openings", "no current openings", "no open openings", "no vacancies", "no current vacancies", "no positions", "no open positions", "no job openings", "no open roles", "not hiring")
FILES = "pdf jpg jpeg png gif svg webp doc docx xls xlsx ppt pptx zip mp4 vcf"
ROLE_WORDS = "engineer developer scientist intern internship manager designer analyst lead associate technician specialist officer executive researcher architect consultant fellow coordinator director programmer administrator representative operator chemist biologist machinist welder accountant trainee apprentice marketer writer strategist"
NO_ROLE_WORDS = "team culture benefits why join apply our career careers openings positions opportunity opportunities values perks reporting with you we will responsible experience working building"
#: Text shorter than this is a shell, not a page.
SHELL = 200

LINK = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "scheme", "host", "path", "query", "fragment", "text")])
SITE = T.StructType(
    [T.StructField("links", T.ArrayType(LINK)), T.StructField("mails", T.ArrayType(T.StringType())), T.StructField("bits", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("title", "meta", "visible", "body")]
)
UNSEEN, FRAME = {"script", "style", "noscript", "template", "svg"}, {"nav", "footer", "header"}
PIECES = {"h1", "h2", "h3", "h4", "h5", "a", "strong", "b", "li", "td"}


class Site(HTMLParser):
    """Links with their words, short pieces of text, title, description and visible text, with and without the page's frame."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.links: list[list] = []
        self.pieces: list[list[str]] = []
        self.title: list[str] = []
        self.metas: dict[str, str] = {}
        self.visible: list[str] = []
        self.body: list[str] = []
        self.path: list[tuple[str, list[str] | None]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "meta":
            self.metas.setdefault((found.get("name") or found.get("property") or "").lower(), (found.get("content") or "").strip())
        if tag in VOID:
            return
        held = [] if tag in PIECES else None
        if tag == "a" and found.get("href") is not None and not self.within(UNSEEN):
            self.links.append([found["href"].strip(), held])
        if held is not None and not self.within(UNSEEN | FRAME):
            self.pieces.append(held)
        self.path.append((tag, held))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.path):
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.within({"title"}):
            self.title.append(data)
        elif not self.within(UNSEEN):
            self.visible.append(data)
            if not self.within(FRAME):
                self.body.append(data)
            for _, held in self.path:
                if held is not None:
                    held.append(data)

    def within(self, tags: set[str]) -> bool:
        return any(t in tags for t, _ in self.path)


def resolved(href: str, base: str) -> tuple | None:
    """(url, scheme, host, path, query, fragment) of a link to a page, the url without its fragment; None for other links."""
    if not href or href.startswith("#"):
        return None
    try:
        parts = urllib.parse.urlsplit(urllib.parse.urljoin(base, href))
        name = parts.hostname
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not name:
        return None
    return urllib.parse.urlunsplit(parts._replace(fragment="")), parts.scheme, name, parts.path, parts.query, parts.fragment


def mail_targets(href: str) -> list[str]:
    if not href.lower().startswith("mailto:"):
        return []
    return [x.strip() for x in urllib.parse.unquote(href[7:]).split("?", 1)[0].split(",")]


@F.udf(SITE, useArrow=False)
def read_site(html: str | None, website: str | None) -> tuple:
    """The parts of a page that the rules read; an address without // is taken as https. Row by row, as the readers in `html`."""
    p, base = Site(html or ""), (website or "").strip()
    base = base if "//" in base else f"https://{base}"
    links = [(*r, flat(held)) for href, held in p.links if (r := resolved(href, base))]
    mails = [m for href, _ in p.links for m in mail_targets(href)]
    bits = [b for b in (flat(held) for held in p.pieces) if b]
    meta = next((p.metas[k] for k in ("description", "og:description") if p.metas.get(k)), None)
    return links, mails, bits, flat(p.title) or None, flat([meta])[:300] if meta else None, flat([" ".join(p.visible)]), flat([" ".join(p.body)])


def any_of(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def path_has(path: Column, words: str) -> Column:
    """Whether one of the words stands in a path, between its separators."""
    marked = F.concat(F.lit("-"), F.regexp_replace(F.lower(path), "[/_.-]+", "-"), F.lit("-"))
    return any_of(marked, [f"-{w}-" for w in words.split(" ")])


def words_are(text: Column, options: str) -> Column:
    """Whether a link's words, without marks around them, are one of the options."""
    return F.regexp_replace(F.lower(F.replace(text, F.lit("’"), F.lit("'"))), r"^\W+|\W+$", "").isin(*options.split("|"))


def is_file(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*FILES.split(" "))


def is_root(link: Column) -> Column:
    return F.rtrim(link["path"], F.lit("/")).isin("", "/index.html", "/index.php")


def first(links: Column) -> Column:
    return F.get(links, F.lit(0))["url"]


def with_kind_pages(rows: DataFrame) -> DataFrame:
    """rows (links, own) with the page of each kind that a site links to on its own domain, in the order of PATH_WORDS.

    The shortest address that says so comes first, of equals the one linked to first; then the first link whose words say
    so. A careers page may be a hiring platform's if that link stands before any of the site's own. A page is of one kind.
    """
    def numbered(found: Column) -> Column:
        return F.transform(found, lambda x, i: F.struct(F.length(x["url"]).alias("n"), i.alias("i"), x["url"].alias("url"), x["own"].alias("own")))

    def page_of(kind: str, used: Column) -> Column:
        def named(x: Column) -> Column:
            return x["own"] & ~is_root(x) & path_has(x["path"], PATH_WORDS[kind])

        def hiring(x: Column) -> Column:
            return ~x["own"] & reduce(lambda a, b: a | b, [(x["host"] == h) | F.endswith(x["host"], F.lit(f".{h}")) for h in HIRING_HOSTS.split(" ")])

        free = F.filter("__marked", lambda x: ~F.array_contains(used, x["url"]))
        if kind == "careers":
            candidates = F.filter(numbered(F.filter(free, lambda x: named(x) | hiring(x))), lambda x: x["own"] | (x["i"] == 0))
        else:
            candidates = numbered(F.filter(free, named))
        worded = F.filter(free, lambda x: x["own"] & ~is_root(x) & ~named(x) & words_are(x["text"], LINK_WORDS[kind]))
        return F.coalesce(F.array_min(candidates)["url"], first(worded))

    own = F.col("own")
    pages = F.filter("links", lambda x: ~is_file(x["path"]))
    rows = rows.withColumn("__marked", F.transform(pages, lambda x: F.struct(*[x[c].alias(c) for c in LINK.names], F.coalesce(registrable(host(x["url"])) == own, F.lit(False)).alias("own"))))
    # a column a kind, so that each is worked out once
    rows = rows.withColumn("__used", F.array().cast("array<string>"))
    for kind in PATH_WORDS:
        rows = rows.withColumn(kind, page_of(kind, F.col("__used"))).withColumn("__used", F.concat("__used", F.array_compact(F.array(kind))))
    return rows.drop("__marked", "__used")


def address(text: Column) -> Column:
    """A mail address in lower case without the marks around it; empty if it is none."""
    bare = F.lower(F.btrim(text, F.lit(" .,;:()<>[]\"'")))
    local, domain = F.substring_index(bare, "@", 1), F.substring_index(bare, "@", -1)
    labels = F.split(domain, r"\.")
    named = F.forall(labels, lambda x: x.rlike("^[a-z0-9-]+$")) & (F.size(labels) > 1) & F.element_at(labels, -1).rlike("^[a-z]{2,24}$")
    return F.when((F.size(F.split(bare, "@")) == 2) & local.rlike("^[a-z0-9][a-z0-9._%+-]*$") & (F.length(local) <= 64) & named, bare).otherwise("")


def contact_email(mails: Column, visible: Column, own: Column) -> Column:
    """The site's own address: a mailbox for strangers first, in the order of MAILBOXES, then the first on the page."""
    words = F.filter(F.split(F.translate(visible, "<>()[]\"',;:/\\", " " * 13), r"\s+"), lambda w: F.contains(w, F.lit("@")))
    found = F.transform(F.concat(mails, words), address)

    def good(m: Column) -> Column:
        local, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
        other = any_of(local, OTHER_MAILBOX) | local.isin(*OTHER_MAILBOX_WHOLE.split(" ")) | F.endswith(local, F.lit("job")) | F.endswith(local, F.lit("jobs"))
        return (m != "") & F.coalesce(registrable(domain) == own, F.lit(False)) & ~domain.isin(*MAIL_HOSTS.split(" ")) & ~local.isin(*NO_MAILBOX.split(" ")) & ~other

    order = F.array(*map(F.lit, MAILBOXES.split(" ")))
    kept = F.transform(F.filter(found, good), lambda m, i: F.struct(F.coalesce(F.nullif(F.array_position(order, F.split_part(m, F.lit("@"), F.lit(1))), F.lit(0)), F.lit(99)).alias("rank"), i.alias("i"), m.alias("m")))
    return F.array_min(kept)["m"]


def contact_page(links: Column, own: Column, website: Column) -> Column:
    """The first page of the site whose address says contact, else the first link whose words do, with its fragment."""
    home = F.rtrim(F.regexp_replace(F.when(F.contains(website, F.lit("//")), F.trim(website)).otherwise(F.concat(F.lit("https://"), F.trim(website))), "#.*$", ""), F.lit("/"))

    def elsewhere(x: Column) -> Column:
        root = is_root(x) & (x["query"] == "")
        jobs = any_of(F.lower(x["path"]), JOB_PARTS) | path_has(x["path"], JOB_WORDS)
        return F.coalesce(registrable(host(x["url"])) == own, F.lit(False)) & ~root & (F.rtrim(x["url"], F.lit("/")) != home) & ~is_file(x["path"]) & ~jobs

    pages = F.filter(links, elsewhere)
    worded = F.get(F.filter(pages, lambda x: words_are(x["text"], CONTACT_LINKS)), F.lit(0))
    whole = F.concat(worded["url"], F.when(worded["fragment"] != "", F.concat(F.lit("#"), worded["fragment"])).otherwise(""))
    return F.coalesce(first(F.filter(pages, lambda x: path_has(x["path"], CONTACT_WORDS))), whole)


def repository(links: Column, own: Column) -> Column:
    """The first account on a code host whose name has the site's in it, or the other way round."""
    def plain(x: Column) -> Column:
        return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")

    label = plain(F.split_part(own, F.lit("."), F.lit(1)))
    accounts = F.transform(links, lambda x: F.struct(F.regexp_replace(x["host"], r"^www\.", "").alias("host"), F.get(F.filter(F.split(x["path"], "/"), lambda s: s != ""), F.lit(0)).alias("name")))

    def matches(a: Column) -> Column:
        name = plain(a["name"])
        alike = F.contains(name, label) | F.contains(label, name)
        return a["host"].isin(*CODE_HOSTS.split(" ")) & a["name"].isNotNull() & ~F.lower(a["name"]).isin(*NO_ACCOUNT.split(" ")) & (F.length(name) >= 3) & alike

    one = F.get(F.filter(accounts, matches), F.lit(0))
    return F.when(F.length(label) >= 3, F.concat(F.lit("https://"), one["host"], F.lit("/"), one["name"]))


def role_titles(bits: Column) -> Column:
    """array<struct<k, i, b>>: role titles among short texts, in order: a role's word in at most six, and no sentence."""
    def words(b: Column) -> Column:
        return F.regexp_extract_all(F.lower(b), F.lit("([a-z]+)"), 1)

    def stem(w: Column) -> Column:
        return F.regexp_replace(w, "s$", "")

    roles, other = F.array(*map(F.lit, ROLE_WORDS.split(" "))), F.array(*map(F.lit, NO_ROLE_WORDS.split(" ")))

    def is_role(b: Column) -> Column:
        w = words(b)
        short = F.length(b).between(4, 60) & (F.size(F.split(b, " ")) <= 6) & ~b.rlike("[.,;]$")
        return short & F.exists(w, lambda x: F.array_contains(roles, x) | F.array_contains(roles, stem(x))) & ~F.exists(w, lambda x: F.array_contains(other, x))

    def title(b: Column) -> Column:
        """What follows a word such as `Job:`."""
        out = b
        for mark in (":", "–", "-"):
            lead = F.substring_index(b, mark, 1)
            led = F.contains(b, F.lit(mark)) & F.lower(F.trim(lead)).isin(*ROLE_LEADS.split(" "))
            out = F.when(led, F.ltrim(F.substr(b, F.length(lead) + 2))).otherwise(out)
        return out

    named = F.transform(F.filter(bits, is_role), title)
    return F.transform(named, lambda b, i: F.struct(F.array_join(F.regexp_extract_all(F.lower(b), F.lit("([a-z0-9]+)"), 1), " ").alias("k"), i.alias("i"), b.alias("b")))


def first_of_keys(keyed: Column) -> Column:
    """The texts of role_titles, each key's first, in order."""
    keys = F.transform(keyed, lambda x: x["k"])
    return F.transform(F.filter(keyed, lambda x, i: F.array_position(keys, x["k"]) == i + 1), lambda x: x["b"])


def sites(pages: DataFrame) -> DataFrame:
    """What each home page (id, website, html) says: contact, pages by kind, repository, roles, parked and how much it holds.

    Contacts of a profile on a platform, of a mail host or of an address without a domain are null. Broken or null HTML has
    no links. parked speaks of the address, and says nothing about who owns it.
    """
    own = registrable(host(F.col("website")))
    site = pages.select("id", "website", own.alias("own"), read_site("html", "website").alias("s")).select("id", "website", "own", "s.*")
    site = with_kind_pages(site).withColumn("__roles", role_titles(F.col("bits"))).withColumn("__titles", first_of_keys(F.col("__roles")))
    reachable = F.col("own").isNotNull() & ~F.col("own").isin(*MAIL_HOSTS.split(" ")) & ~is_profile(F.col("website"))
    said = F.lower("visible")
    return site.select(
        "id",
        F.when(reachable, contact_email(F.col("mails"), F.col("visible"), F.col("own"))).alias("contact_email"),
        F.when(reachable, contact_page(F.col("links"), F.col("own"), F.col("website"))).alias("contact_page"),
        *PATH_WORDS,
        repository(F.col("links"), F.col("own")).alias("repo"),
        any_of(said, PARKED).alias("parked"),
        any_of(said, NO_OPENINGS).alias("says_none"),
        F.size("__titles").alias("roles"),
        F.slice("__titles", 1, 6).alias("titles"),
        "title",
        "meta",
        F.length("body").alias("text_chars"),
        (F.length("body") < SHELL).alias("thin"),
    )


def outcome(code: Column, robots_allow: Column, thin: Column) -> Column:
    """What a linked page came to: robots, ok, thin, missing, refused or unreachable (E-23); none says that a site is inactive."""
    return (
        F.when(~robots_allow, "robots")
        .when(code.between(200, 299), F.when(thin, "thin").otherwise("ok"))
        .when(code.isin(404, 410), "missing")
        .when(code.isin(401, 403, 429), "refused")
        .otherwise("unreachable")
    )


def allowed(robots: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (host, path) with allowed, by a site's rules (host, allow, prefix): the longest prefix counts, allow before disallow."""
    rules = robots.where("prefix <> ''").select("host", "allow", "prefix")
    hits = requests.select("host", "path").distinct().join(rules, "host").where(F.startswith("path", "prefix"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("prefix").alias("n"), F.col("allow").alias("allow"))).alias("r"))
    return requests.join(best, ["host", "path"], "left").withColumn("allowed", F.coalesce("r.allow", F.lit(True))).drop("r")
