"""Postings of feeds and HTML lists: cards cut out of landed pages by a pattern, and fields read from each by rules.

A landing row is as in adapters.py. What a browser would select is written as rows of patterns, so that a new site is new rows. Nested
elements of one name are where patterns differ from a browser; cards of the sites read here have none around their fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions import jsonld
from jobloom.functions.extract import NOT_GIVEN, contracts, extract_cities, extract_salary, extract_skills, has_any, whole_words, work_mode
from jobloom.functions.text import field_text, html_text, keyword_match, linkedin_url, with_once
from jobloom.operators.offers import Profile, preferred_city
from jobloom.operators.pages import absolute, asked_for, page_description, page_facts
from jobloom.sources.adapters import first_or_last, offer_columns

#: What one posting is, by source.
CARDS = {
    "teamtailor": r"(?is)<item\b.*?</item>",
    "successfactors": r"(?is)<(?:tr|li)\b(?:(?!</(?:tr|li)>).)*?jobTitle-link.*?</(?:tr|li)>",
    "erecruiter": r"(?is)<tr\b[^>]*\bofferid=.*?</tr>",
    "nabory_kprm": r"""(?is)<li\b[^>]*class=["'][^"']*\brow\b.*?</li>""",
    "justjoinit": r"""(?is)<article\b(?:(?!</article>).)*?/job-offer/.*?</article>""",
    "nofluffjobs": r"""(?is)<a\b[^>]*\bposting-list-item\b[^>]*>.*?</a>""",
    "rocketjobs": r"""(?is)<article\b(?:(?!</article>).)*?/oferta-pracy/.*?</article>""",
    "linkedin": r"""(?is)<li\b[^>]*>(?:(?!</li>).)*?job-search-card.*?</li>""",
}
#: source -> rules (field, pattern) in order of priority: the first pattern of a field that gives a text counts.
RULES = {
    "teamtailor": (
        ("title", r"(?is)<title>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</title>"), ("href", r"(?is)<link>(.*?)</link>"), ("mode", r"(?is)<remoteStatus>(.*?)</remoteStatus>"),
        ("description", r"(?is)<description>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</description>"),
    ),
    "successfactors": (
        ("title", r"(?is)<a\b[^>]*\bjobTitle-link\b[^>]*>(.*?)</a>"), ("href", r"""(?is)<a\b(?=[^>]*\bjobTitle-link\b)[^>]*\bhref=["']([^"']*)"""),
        ("location", r"""(?is)<(?:span|div|td)\b[^>]*class=["'][^"']*[lL]ocation[^"']*["'][^>]*>(.*?)</(?:span|div|td)>"""),
    ),
    "erecruiter": (
        ("id", r"""(?is)<tr\b[^>]*\bofferid=["']?([^"'\s>]+)"""), ("title", r"""(?is)<td\b[^>]*\bskk_positionName\b[^>]*>(.*?)</td>"""), ("title", r"(?is)<td\b[^>]*>(.*?)</td>"),
        ("location", r"(?is)^.*<td\b[^>]*>.*?</td>.*<td\b[^>]*>(.*?)</td>"),
    ),
    "nabory_kprm": (
        ("href", r"""(?is)<a\b(?=[^>]*\bsingle\b)[^>]*\bhref=["']([^"']*)"""), ("title", r"""(?is)<strong\b[^>]*\btitle\b[^>]*>(.*?)</strong>"""),
        ("company", r"(?is)<span>\s*urząd:?\s*</span>\s*<b>(.*?)</b>"), ("unit", r"(?is)<span>\s*dział:?\s*</span>\s*<b>(.*?)</b>"),
        ("location", r"(?is)<span>\s*miejscowość:?\s*</span>\s*<b>(.*?)</b>"), ("expires_in", r"(?is)<span>\s*ważne do:?\s*</span>\s*<b>(.*?)</b>"),
    ),
    "justjoinit": (
        ("href", r"""(?is)<a\b(?=[^>]*\boffer-card\b)[^>]*\bhref=["']([^"']*/job-offer/[^"']*)"""), ("title", r"""(?is)<a\b[^>]*\boffer_list_offer_title_link\b[^>]*>(.*?)</a>"""),
        ("company", r"""(?is)<object\b.*?<img\b[^>]*\balt=["']([^"']+)"""), ("company", r"(?is)<p\b[^>]*>(.*?)</p>"), ("expires_in", r"(?i)\b(New|Expires tomorrow|\d+d left)\b"),
    ),
    "nofluffjobs": (
        ("href", r"""(?is)^<a\b[^>]*\bhref=["']([^"']*/pl/job/[^"']*)"""), ("title", r"""(?is)<(?:h3|span|div)\b[^>]*data-cy=["']title position on the job offer listing["'][^>]*>(.*?)</(?:h3|span|div)>"""),
        ("title", r"(?is)<h3\b[^>]*>(.*?)</h3>"), ("company", r"(?is)<h4\b[^>]*\bcompany-name\b[^>]*>(.*?)</h4>"), ("company", r"""(?is)<span\b(?![^>]*data-cy)[^>]*\btw-truncate\b[^>]*>(.*?)</span>"""),
        ("salary_text", r"""(?is)data-cy=["']salary ranges on the job offer listing["'][^>]*>(.*?)</(?:span|div)>"""), ("place", r"""(?is)data-cy=["']location on the job offer listing["'][^>]*>(.*?)</(?:span|div)>"""),
    ),
    "rocketjobs": (
        ("href", r"""(?is)<a\b(?=[^>]*\boffer-card\b)[^>]*\bhref=["']([^"']*/oferta-pracy/[^"']*)"""), ("title", r"(?is)<h[2-4]\b[^>]*>(.*?)</h[2-4]>"),
        ("title", r"""(?is)<a\b(?=[^>]*\boffer-card\b)[^>]*\btitle=["'](?:Zobacz ofertę\s*)?([^"']*)"""), ("company", r"(?is)lucide-building\b.*?<p\b[^>]*>(.*?)</p>"),
        ("company", r"""(?is)<object\b.*?<img\b[^>]*\balt=["']([^"']+)"""), ("location", r"(?is)lucide-map-pin\b.*?<p\b[^>]*>(.*?)</p>"),
    ),
    "linkedin": (
        ("href", r"""(?is)<a\b(?=[^>]*\bbase-card__full-link\b)[^>]*\bhref=["']([^"']*/jobs/view/[^"']*)"""), ("title", r"(?is)<h3\b[^>]*\bbase-search-card__title\b[^>]*>(.*?)</h3>"),
        ("company", r"(?is)<h4\b[^>]*\bbase-search-card__subtitle\b[^>]*>(.*?)</h4>"), ("location", r"(?is)<span\b[^>]*\bjob-search-card__location\b[^>]*>(.*?)</span>"),
        ("expires_in", r"""(?is)<time\b[^>]*\bdatetime=["']([^"']*)"""),
    ),
}
#: Which card of a URL counts, the page that relative links start from, the source's name.
POLICY = {"successfactors": "first", "nabory_kprm": "first", "justjoinit": "first", "rocketjobs": "first", "nofluffjobs": "last", "linkedin": "last"}
BASE = {"nabory_kprm": "https://nabory.kprm.gov.pl/", "justjoinit": "https://justjoin.it/", "nofluffjobs": "https://nofluffjobs.com", "rocketjobs": "https://rocketjobs.pl", "linkedin": "https://www.linkedin.com"}
NAMES = {"justjoinit": "JustJoinIT", "nofluffjobs": "No Fluff Jobs", "rocketjobs": "RocketJobs", "linkedin": "LinkedIn", "nabory_kprm": "Budżetówka (nabory.kprm.gov.pl)", "pracuj": "Pracuj.pl"}
# Names of modes and contracts on one portal's cards; of several modes the first counts.
JJIT_MODES = ("Remote", "Hybrid", "Office", "Mobile")
JJIT_CONTRACTS = ("B2B", "Permanent", "Mandate contract", "Contract", "Any")
FIELDS = ("href", "id", "title", "company", "location", "place", "mode", "description", "salary_text", "unit", "expires_in")
#: Rows of a list that count for a phrase.
PER_PHRASE = 60


def cards(landing: DataFrame, source: str) -> DataFrame:
    """A row for each card: the landing's columns but the body, place, _card and every field of FIELDS as text, empty if it has none."""
    body = F.coalesce("body", F.lit(""))
    if source == "erecruiter":  # JSON in a call, and HTML in that
        body = F.coalesce(F.get_json_object(F.regexp_extract(body, r"(?s)\((.*)\)\s*;?\s*$", 1), "$.htm"), F.lit(""))
    kept = ["company", "key", "phrase_no", "seq", "remote_only", "filtered"]
    defaults = {"key": F.lit(""), "phrase_no": F.lit(0), "seq": F.lit(0), "remote_only": F.lit(False), "filtered": F.lit(True), "company": F.lit("")}
    given = [F.coalesce(F.col(c), defaults[c]).alias(f"_l_{c}" if c == "company" else c) if c in landing.columns else defaults[c].alias(f"_l_{c}" if c == "company" else c) for c in kept]
    each = landing.select(*given, F.posexplode(F.regexp_extract_all(body, F.lit(CARDS[source]), F.lit(0))).alias("place_in_page", "_card"))
    # what the rules find, and of portals the card, go through one field_text, each once a row
    texts = [(field, pattern) for field, pattern in RULES[source] if field != "description"]
    read = with_once(each, _texts=F.transform(F.array(F.col("_card") if source in NAMES else F.lit(""), *[F.regexp_extract("_card", pattern, 1) for _, pattern in texts]), field_text))
    found: dict[str, list[Column]] = {f: [] for f in FIELDS}
    for i, (field, _) in enumerate(texts, 1):
        found[field].append(F.nullif(F.get("_texts", F.lit(i)), F.lit("")))
    for field, pattern in RULES[source]:
        if field == "description":
            found[field].append(F.nullif(F.regexp_extract("_card", pattern, 1), F.lit("")))
    fields = [F.coalesce(*c, F.lit("")).alias(f) if c else F.lit("").alias(f) for f, c in found.items()]
    return read.select("_l_company", "key", "phrase_no", "seq", "remote_only", "filtered", "place_in_page", "_card", F.get("_texts", F.lit(0)).alias("_text"), *fields)


def read_cards(landing: DataFrame, source: str, profile: Profile = Profile()) -> DataFrame:
    """Offers of a source that lists them as cards. Cards without a title or a link are none."""
    c = cards(landing.where(F.col("source") == source), source)
    url = _address(F.col("href"), F.col("key"), source)
    text, title = F.col("_text"), F.col("title")
    company = _or_not_given("company") if source in ("nofluffjobs", "rocketjobs", "justjoinit") else F.col("company") if source == "linkedin" else F.col("_l_company")
    ready = title != ""
    if source == "erecruiter":
        url = F.concat(F.lit("https://skk.erecruiter.pl/Offer.aspx?oid="), "id", F.lit("&cfg="), "key")
    elif source == "linkedin":
        url = linkedin_url(F.col("href"))
        ready = ready & (F.col("href") != "") & (F.col("company") != "") & (F.col("location") != "")
    c = c.where(ready)
    if source == "successfactors":  # of a phrase, results within the country, else all
        inside = c.where("filtered").select("_l_company", "phrase_no").distinct().withColumn("_in", F.lit(True))
        c = c.join(inside, ["_l_company", "phrase_no"], "left").where("filtered or _in is null").drop("_in")
    c = c.withColumn("_shown", company).withColumn("url", url)
    blank = F.lit("")
    new = {"url": F.col("url"), "company": F.col("_shown"), "location": F.col("location"), "mode": F.col("mode"), "contract": blank, "salary": blank, "description": F.col("description"), "title": title}
    if source == "teamtailor":
        pair = lambda x: F.concat_ws(", ", *[F.nullif(html_text(F.regexp_extract(x, rf"(?is)<tt:{t}>(.*?)</tt:{t}>", 1)), F.lit("")) for t in ("city", "country")])
        places = F.transform(F.regexp_extract_all("_card", F.lit(r"(?is)<tt:location>(.*?)</tt:location>"), F.lit(1)), pair)
        status = F.lower("mode")
        new |= {"location": F.array_join(F.filter(places, lambda p: p != ""), "; "), "mode": F.when(status.isin("fully", "remote"), "remote").when(status == "hybrid", "hybrid").otherwise("")}
    elif source == "erecruiter":
        city = F.col("location")
        new |= {"location": F.when((city != "") & ~city.contains(","), F.concat(city, F.lit(", Polska"))).otherwise(city)}
    elif source == "linkedin":
        cities = F.size(extract_cities(F.col("location")))
        new |= {"mode": F.when(F.col("remote_only") & (cities == 0), "remote").otherwise("")}
    elif source == "nofluffjobs":
        near = F.contains(F.lower(text), F.lit(profile.city.lower()))
        shown = F.when(F.col("place") != "", F.col("place")).otherwise(text)
        new |= {"title": F.trim(F.replace(title, F.lit("NOWA"), F.lit(""))), "location": F.when(near, profile.city).otherwise("Remote"), "mode": shown, "contract": text, "salary": extract_salary(F.col("salary_text"))}
    elif source == "rocketjobs":
        new |= {"mode": text, "contract": text, "salary": extract_salary(text)}
    elif source == "justjoinit":
        parts = F.transform(F.regexp_extract_all("_card", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), field_text)
        place = F.get(F.filter(parts, lambda p: (p != "") & (p != F.col("company")) & ~p.isin("Remote", "Hybrid", "Office", "Mobile")), F.lit(0))
        pay = F.replace(F.regexp_extract(text, r"(?iU)(?<!\d)(?:\d[\d\s,.]*+-\s*)?\d[\d\s,.]*+(?:PLN|EUR|USD|CHF)\s*/\s*(?:h|hour|day|month)", 0), F.lit(" "), F.lit(" "))
        new |= {"location": F.coalesce(place, F.lit("")), "mode": text, "contract": text, "salary": pay}
        new |= {"_mode": F.get(whole_words(text, JJIT_MODES), F.lit(0)), "_contracts": whole_words(text, JJIT_CONTRACTS)}
    places = ("phrase_no", "seq", "place_in_page")
    made = c.select(
        *[v.alias(k) for k, v in new.items()], *places, "unit", text.alias("_text"),
        F.when(F.lit(source).isin("nofluffjobs", "rocketjobs"), F.when(F.lower(text).contains("nowa"), "Nowa").otherwise("")).otherwise(F.col("expires_in")).alias("expires_in"),
    )
    made = with_once(made, **{k: F.col(k) for k, v in new.items() if v is not blank and k != "description"})
    if all(field != "description" for field, _ in RULES[source]):
        made = made.drop("description")
    portal = source in NAMES
    # a portal's skills are looked for in the whole card, and it says until when an offer stands
    rows = made.withColumn("_skills", F.col("_text")) if portal else made.drop("expires_in")
    offers = offer_columns(rows, NAMES.get(source, f"Strona kariery ({source})"), NOT_GIVEN if portal else "", confirmed=not portal and source != "successfactors", kept=places)
    # after a card is read, so that the shuffle carries what was found and neither the card nor its text
    return first_or_last(offers, POLICY.get(source, ""), by=places).drop(*places)


def _address(href: Column, key: Column, source: str) -> Column:
    base = F.when(key != "", key).otherwise(F.lit(BASE.get(source, "")))
    return F.when(href.rlike("^[a-zA-Z]+://"), href).otherwise(absolute(href, F.concat(base, F.lit("/"))))


def nofluffjobs_urls(landing: DataFrame) -> DataFrame:
    """The urls of all links to postings in landed lists, those of the cards among them, without reading the cards."""
    own = landing.where("source = 'nofluffjobs'")
    key = F.coalesce("key", F.lit("")) if "key" in landing.columns else F.lit("")
    links = own.select(key.alias("key"), F.explode(F.regexp_extract_all("body", F.lit(r"""(?is)\bhref=["']([^"']*/pl/job/[^"']*)"""), F.lit(1))).alias("_h"))
    return links.select("key", field_text(F.col("_h")).alias("href")).select(_address(F.col("href"), F.col("key"), "nofluffjobs").alias("url"))


def _or_not_given(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name)).otherwise(NOT_GIVEN)


def nofluffjobs_details(offers: DataFrame, pages: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """offers with what their own page (url, status, html) says: its description, and from that the mode, contracts and salary that the card does not
    give, and more skills; the company from the posting embedded where the card has none. Offers whose page was not read stay as they are.
    urls: those of all offers, perhaps more, where they come cheaper than offers, which are then made once."""
    facts = page_facts(asked_for(pages.where("status = 200"), offers if urls is None else urls)).select(F.col("url").alias("_u"), "embedded", "main_text", "organization")
    both = offers.join(facts, F.col("url") == F.col("_u"), "left")
    staged = both.withColumn("_d", F.when(F.col("_u").isNotNull(), page_description(F.col("title"))))
    read, d = F.col("_u").isNotNull(), F.col("_d")
    named = F.when(F.col("company") == NOT_GIVEN, F.coalesce(F.nullif("organization", F.lit("")), F.col("company"))).otherwise(F.col("company"))
    return staged.withColumns({
        "company": named, "description": F.when(read, d).otherwise(F.col("description")), "work_mode": F.when(read & (F.col("work_mode") == NOT_GIVEN), work_mode(d)).otherwise(F.col("work_mode")),
        "contract_types": F.when(read & (F.size("contract_types") == 0), contracts(d)).otherwise(F.col("contract_types")),
        "salary": F.when(read & (F.col("salary") == ""), extract_salary(d)).otherwise(F.col("salary")),
        "skills": F.when(read, F.array_distinct(F.concat("skills", extract_skills(d)))).otherwise(F.col("skills")),
    }).select(*offers.columns)


def linkedin_details(offers: DataFrame, pages: DataFrame, keywords) -> DataFrame:
    """offers whose title has a keyword, with what their own page (url, html) says: closed ones are marked so and keep the rest."""
    low = F.lower(html_text(F.col("html")))
    box = lambda name: F.regexp_extract("html", rf"(?is)<div\b[^>]*\b{name}\b[^>]*>(.*?)</div>", 1)
    text = html_text(F.coalesce(F.nullif(box("show-more-less-html__markup"), F.lit("")), box("description__text")))
    facts = pages.select(F.col("url").alias("_u"), has_any(low, ("no longer accepting applications", "nie przyjmujemy już aplikacji")).alias("_closed"), text.alias("_d"))
    both = offers.where(keyword_match(F.col("title"), list(keywords))).join(facts, F.col("url") == F.col("_u"), "left")
    read = F.coalesce(~F.col("_closed"), F.lit(False))
    mode = work_mode(F.concat_ws(" ", "title", "_d"))
    return both.withColumns({
        "expires_in": F.when(F.col("_closed"), "Zamknięta").otherwise(F.col("expires_in")), "description": F.when(read, F.col("_d")).otherwise(F.col("description")),
        "work_mode": F.when(read & (mode != NOT_GIVEN), mode).otherwise(F.col("work_mode")), "contract_types": F.when(read, contracts(F.col("_d"))).otherwise(F.col("contract_types")),
        "salary": F.when(read, extract_salary(F.col("_d"))).otherwise(F.col("salary")), "skills": F.when(read, extract_skills(F.col("_d"))).otherwise(F.col("skills")),
    }).drop("_u", "_closed", "_d")


def nabory(landing: DataFrame, pages: DataFrame, keywords, profile: Profile = Profile()) -> DataFrame:
    """Civil-service offers: up to PER_PHRASE cards a phrase, each URL under its first phrase, with their pages (url, html). The title is rank,
    matters and unit, and needs a keyword; the contract is always permanent."""
    c = cards(landing.where("source = 'nabory_kprm'"), "nabory_kprm").where("href <> ''")
    c = c.withColumn("url", absolute(F.col("href"), F.lit(BASE["nabory_kprm"]))).withColumn("_board", F.lit("nabory"))
    at = Window.partitionBy("phrase_no").orderBy("seq", "place_in_page")
    top = c.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= PER_PHRASE).drop("_n")
    top = first_or_last(top.drop("place", "company").withColumn("company", F.lit("")).withColumn("place", F.col("place_in_page")), "first").select("url", "title", "unit", F.col("location").alias("_place"), F.col("expires_in"), "_card")
    part = lambda name: html_text(F.regexp_extract("html", rf"""(?is)<(\w+)\b[^>]*class=["'][^"']*{name}[^"']*["'][^>]*>(.*?)</\1>""", 2))
    facts = pages.select(
        F.col("url").alias("_u"), part("job-title__institution-title").alias("_rank"), F.regexp_replace(part("job-title__position-matters"), r"(?i)^do spraw:?\s*", "").alias("_matters"),
        part("job-title__institution-unit").alias("_unit"), F.concat_ws(" ", part("responsibilities"), part("requirements")).alias("_body"), part("info-circle__content--address").alias("_address"),
        part("info-circle__content--salary").alias("_salary"), part("office-data__office-name").alias("_office"),
    )
    both = top.join(facts, F.col("url") == F.col("_u"))
    some = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    named = F.concat_ws(" – ", F.nullif(some("_rank", "title"), F.lit("")), F.nullif("_matters", F.lit("")))
    unit = some("_unit", "unit")
    full = F.when(unit != "", F.concat(named, F.lit(" ("), unit, F.lit(")"))).otherwise(named)
    office = html_text(F.regexp_extract("_card", r"(?is)<span>\s*urząd:?\s*</span>\s*<b>(.*?)</b>", 1))
    place = some("_address", "_place")
    near = preferred_city(place, profile)
    mode = work_mode(F.col("_body"))
    made = both.select(
        F.coalesce(F.nullif("_office", F.lit("")), office).alias("company"), full.alias("title"), F.coalesce(F.nullif(F.when(near, profile.city).otherwise(place), F.lit("")), F.lit(NOT_GIVEN)).alias("location"),
        F.when(mode != NOT_GIVEN, mode).otherwise("Office").alias("work_mode"), F.array(F.lit("Permanent")).alias("contract_types"), extract_salary(F.col("_salary")).alias("salary"), "url",
        F.lit(NAMES["nabory_kprm"]).alias("source"), extract_skills(F.col("_body")).alias("skills"), F.substring("_body", 1, 8000).alias("description"), F.lit(True).alias("api_confirmed"), "expires_in",
    )
    return made.where(keyword_match(F.col("title"), list(keywords)))


# Work modes of a portal's lists.
PRACUJ_MODES = (("praca zdalna", "Remote"), ("praca hybrydowa", "Hybrid"), ("praca stacjonarna", "Office"), ("praca mobilna", "Mobile"))
_GROUP = (
    "array<struct<jobTitle:string,companyName:string,offers:array<struct<displayWorkplace:string,offerAbsoluteUri:string,isWholePoland:boolean>>,workModes:array<string>,"
    "typesOfContract:array<string>,salaryDisplayText:string,jobDescription:string,expirationDate:string>>"
)


def pracuj_salary(text: Column) -> Column:
    """Up to two amounts before the currency, with kind and unit in one form."""
    amounts = F.regexp_extract_all(F.get(F.split(F.coalesce(text, F.lit("")), "zł"), F.lit(0)), F.lit(r"(?U)\d[\d\s]*(?:,\d+)?"), F.lit(0))
    tidy = F.transform(amounts, lambda a: F.trim(F.regexp_replace(a, r"(?U)\s+", " ")))
    low = F.lower(F.coalesce(text, F.lit("")))
    unit = F.when(low.contains("godz"), " /h").when(low.contains("mies"), " /month").when(low.contains("rok"), " /year").otherwise("")
    kind = F.when(low.contains("netto"), " netto").when(low.contains("brutto"), " brutto").otherwise("")
    return F.when(F.size(tidy) > 0, F.concat(F.array_join(F.slice(tidy, 1, 2), " - "), F.lit(" PLN"), kind, unit)).otherwise("")


def read_pracuj(landing: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Offers of pages that hold their data as JSON in a script, grouped by posting; each URL once, the first. Of several places the preferred city's
    link counts, and all places are named."""
    own = landing.where("source = 'pracuj'")
    given = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in landing.columns else F.lit(0)
    data = F.regexp_extract(F.coalesce("body", F.lit("")), r"""(?is)<script id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>""", 1)
    found = own.select(given("phrase_no").alias("phrase_no"), given("seq").alias("seq"), jsonld.first_value(data, "groupedOffers").alias("_g"))
    each = found.select("phrase_no", "seq", F.posexplode(F.from_json("_g", _GROUP)).alias("place", "g"))
    near = F.get(F.filter("g.offers", lambda o: preferred_city(o["displayWorkplace"], profile)), F.lit(0))
    chosen = F.coalesce(near, F.get("g.offers", F.lit(0)))
    places = F.array_distinct(F.filter(F.transform("g.offers", lambda o: F.coalesce(o["displayWorkplace"], F.lit(""))), lambda p: p != ""))
    whole = F.exists("g.offers", lambda o: F.coalesce(o["isWholePoland"], F.lit(False)))
    places = F.when(whole, F.concat(places, F.array(F.lit("cała Polska")))).otherwise(places)
    modes = F.transform(F.coalesce("g.workModes", F.array().cast("array<string>")), F.lower)
    mode = F
    for name in ("Remote", "Hybrid", "Office", "Mobile"):
        mode = mode.when(F.arrays_overlap(modes, F.array(*[F.lit(k) for k, v in PRACUJ_MODES if v == name])), name)
    text = lambda c: F.coalesce(F.col(f"g.{c}"), F.lit(""))
    made = each.select(
        "phrase_no", "seq", "place", F.coalesce(F.nullif(text("companyName"), F.lit("")), F.lit(NOT_GIVEN)).alias("company"), F.trim(F.regexp_replace(text("jobTitle"), r"(?U)\s+", " ")).alias("title"),
        F.coalesce(F.nullif(F.array_join(places, "; "), F.lit("")), F.lit(NOT_GIVEN)).alias("location"), mode.otherwise(NOT_GIVEN).alias("work_mode"),
        contracts(F.array_join("g.typesOfContract", " ")).alias("contract_types"), pracuj_salary(text("salaryDisplayText")).alias("salary"), F.coalesce(chosen["offerAbsoluteUri"], F.lit("")).alias("url"),
        F.lit(NAMES["pracuj"]).alias("source"), extract_skills(text("jobDescription")).alias("skills"), F.substring(text("expirationDate"), 1, 10).alias("expires_in"), text("jobDescription").alias("description"), F.lit(True).alias("api_confirmed"),
    )
    kept = made.where("title <> '' and url <> ''").withColumn("_company", F.col("company")).withColumn("company", F.lit(""))
    return first_or_last(kept, "first").withColumn("company", F.col("_company")).drop("_company", "phrase_no", "seq", "place")
