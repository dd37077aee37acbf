"""Paper records from literature services.

A Spark data source per service yields the raw items of its answers (``query``, ``n``, ``item``); paging is one loop
over what the service says about itself. ``search`` projects the items to records with column expressions, so recorded
items (a table, a JSON file) go through the same plan as fresh ones.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.functions import scalars as S
from skein.functions import text as T
from skein.streaming.flows import backoff

FIELDS = ("paper_id", "title", "doi", "pmid", "pmcid", "year", "journal", "authors", "abstract", "pdf_url", "url", "source")
RAW = "query string, n int, item string"
# Addresses of the services, what is asked of them, and their limits.
EUROPE_PMC = "https://www.ebi.ac.uk/europepmc/webservices/rest/search"
RENDER = "https://europepmc.org/backend/ptpmcrender.fcgi?accid=%s&blobtype=pdf"
EUTILS = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils"
SEMANTIC_SCHOLAR = "https://api.semanticscholar.org/graph/v1/paper/search"
OPEN_ACCESS = {"format": "json", "resultType": "core", "sort": "CITED desc"}
SCHOLAR_FIELDS = {"fields": "title,abstract,year,venue,externalIds,openAccessPdf,authors,url", "openAccessPdf": ""}
PUBMED_LIST = {"db": "pubmed", "retmode": "json", "sort": "relevance"}
PAGE, SCHOLAR_END, LISTED_AUTHORS, BUSY = 100, 1000, 8, (429, 500, 502, 503, 504)

Fetch = Callable[[str, dict], bytes]
#: A page: its items, and the cursor of the next page or None.
Page = tuple[list[str], "str | int | None"]


@dataclass(frozen=True)
class Service:
    """What paging and projection need to know of a service."""

    start: str | int
    page: Callable[[Fetch, str, int, object], Page]
    project: Callable[[Column], dict[str, Column]]
    usable: Callable[[str], bool] = lambda item: True
    pause: float = 0.0
    key_header: str | None = None
    key_param: str | None = None
    #: Whether an error after the first page only ends the search.
    lenient: bool = False


def _dumped(items: list) -> list[str]:
    return [json.dumps(x, ensure_ascii=False) for x in items]


# Pages ----------------------------------------------------------------------------------------------------------


def _europe_pmc_page(fetch: Fetch, query: str, wanted: int, cursor: object) -> Page:
    answer = json.loads(fetch(EUROPE_PMC, OPEN_ACCESS | {"query": f"({query}) AND OPEN_ACCESS:y AND HAS_PDF:y", "pageSize": min(PAGE, wanted), "cursorMark": cursor}))
    following = answer.get("nextCursorMark")
    return _dumped((answer.get("resultList") or {}).get("result") or []), following if following != cursor else None


def _scholar_page(fetch: Fetch, query: str, wanted: int, offset: int) -> Page:
    answer = json.loads(fetch(SEMANTIC_SCHOLAR, SCHOLAR_FIELDS | {"query": query, "offset": offset, "limit": min(PAGE, max(wanted, 10))}))
    following = answer.get("next")
    return _dumped(answer.get("data") or []), following if following is not None and following < SCHOLAR_END else None


def _pubmed_page(fetch: Fetch, query: str, wanted: int, start: int) -> Page:
    """A block of ids, and their articles as XML."""
    listed = json.loads(fetch(f"{EUTILS}/esearch.fcgi", PUBMED_LIST | {"term": f"({query}) AND free full text[filter] AND hasabstract", "retmax": min(PAGE, wanted), "retstart": start}))
    ids = listed["esearchresult"].get("idlist") or []
    if not ids:
        return [], None
    xml = fetch(f"{EUTILS}/efetch.fcgi", {"db": "pubmed", "retmode": "xml", "id": ",".join(ids)}).decode()
    more = len(ids) == PAGE and len(ids) < wanted
    return re.findall(r"(?s)<PubmedArticle\b.*?</PubmedArticle>", xml), start + len(ids) if more else None


def items(service: Service, query: str, limit: int, fetch: Fetch) -> Iterator[str]:
    """Up to ``limit`` usable items of a query, page by page."""
    cursor, left = service.start, limit
    while left > 0 and cursor is not None:
        try:
            found, cursor = service.page(fetch, query, left, cursor)
        except urllib.error.HTTPError:
            if service.lenient and left < limit:
                return
            raise
        kept = [x for x in found if service.usable(x)][:left]
        yield from kept
        left -= len(kept)
        if not found:
            return


# Projections ----------------------------------------------------------------------------------------------------


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


_EUROPE_PMC = (
    "title string, doi string, pmid string, pmcid string, pubYear string, abstractText string, authorString string, source string, journalTitle string, "
    "journalInfo struct<journal:struct<title:string>>, fullTextUrlList struct<fullTextUrl:array<struct<documentStyle:string,availability:string,url:string>>>"
)
_SCHOLAR = (
    "paperId string, title string, abstract string, year string, venue string, url string, openAccessPdf struct<url:string>, authors array<struct<name:string>>, "
    "externalIds struct<DOI:string,PubMed:string,PubMedCentral:string>"
)
_PUBMED = (
    "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,"
    "ArticleDate:struct<Year:string>,Abstract:struct<AbstractText:array<string>>,AuthorList:struct<Author:array<struct<LastName:string,Initials:string>>>>>,"
    "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
)


def _europe_pmc(item: Column) -> dict[str, Column]:
    r = F.from_json(item, _EUROPE_PMC)
    free = F.filter(r["fullTextUrlList"]["fullTextUrl"], lambda u: (u["documentStyle"] == "pdf") & F.lower(u["availability"]).isin("open access", "free"))
    page = F.format_string("https://europepmc.org/article/%s/%s", F.coalesce(r["source"], F.lit("MED")), F.coalesce(_some(r["pmid"]), r["pmcid"], F.lit("")))
    return {
        "title": T.strip_markup(r["title"]), "doi": r["doi"], "pmid": r["pmid"], "pmcid": r["pmcid"], "year": r["pubYear"], "authors": r["authorString"], "abstract": T.strip_markup(r["abstractText"]), "url": page,
        "journal": F.coalesce(r["journalInfo"]["journal"]["title"], r["journalTitle"]), "pdf_url": F.coalesce(F.try_element_at(free, F.lit(1))["url"], F.when(r["pmcid"].isNotNull(), F.format_string(RENDER, r["pmcid"]))),
    }


def _scholar(item: Column) -> dict[str, Column]:
    r = F.from_json(item, _SCHOLAR)
    pmc = r["externalIds"]["PubMedCentral"]
    names = F.array_join(F.transform(F.slice(r["authors"], 1, LISTED_AUTHORS), lambda a: F.coalesce(a["name"], F.lit(""))), ", ")
    return {
        "title": T.strip_markup(r["title"]), "doi": r["externalIds"]["DOI"], "pmid": r["externalIds"]["PubMed"], "pmcid": F.when(F.upper(pmc).startswith("PMC"), pmc).otherwise(F.concat(F.lit("PMC"), pmc)), "year": r["year"],
        "authors": _some(names), "abstract": T.strip_markup(r["abstract"]), "url": r["url"], "journal": _some(r["venue"]), "pdf_url": r["openAccessPdf"]["url"], "fallback": r["paperId"],
    }


def _pubmed(item: Column) -> dict[str, Column]:
    r = F.from_xml(F.regexp_replace(item, r"</?(?:i|b|u|sup|sub)>", ""), _PUBMED)
    a = r["MedlineCitation"]["Article"]
    named = F.filter(F.slice(a["AuthorList"]["Author"], 1, LISTED_AUTHORS), lambda p: p["LastName"].isNotNull())
    ids = lambda kind: F.try_element_at(F.filter(r["PubmedData"]["ArticleIdList"]["ArticleId"], lambda x: x["_IdType"] == kind), F.lit(1))["_VALUE"]
    pmid, pmcid, date = F.trim(r["MedlineCitation"]["PMID"]), _some(F.trim(ids("pmc"))), a["Journal"]["JournalIssue"]["PubDate"]
    return {
        "title": F.trim(a["ArticleTitle"]), "doi": F.trim(ids("doi")), "pmid": pmid, "pmcid": pmcid, "year": F.coalesce(date["Year"], a["ArticleDate"]["Year"], date["MedlineDate"]),
        "authors": _some(F.array_join(F.transform(named, lambda p: F.concat_ws(" ", p["LastName"], p["Initials"])), ", ")), "abstract": F.array_join(F.transform(a["Abstract"]["AbstractText"], F.trim), " "),
        "journal": _some(a["Journal"]["Title"]), "url": F.format_string("https://pubmed.ncbi.nlm.nih.gov/%s/", pmid), "pdf_url": F.when(pmcid.isNotNull(), F.format_string(RENDER, pmcid)),
    }


def _has_text_or_pdf(item: str) -> bool:
    r = json.loads(item)
    return bool(r.get("abstractText") or r.get("pmcid") or any(u.get("documentStyle") == "pdf" for u in (r.get("fullTextUrlList") or {}).get("fullTextUrl") or []))


SERVICES = {
    "europe_pmc": Service("*", _europe_pmc_page, _europe_pmc, _has_text_or_pdf),
    "pubmed": Service(0, _pubmed_page, _pubmed, pause=0.4, key_param="api_key"),
    "semantic_scholar": Service(0, _scholar_page, _scholar, lambda x: bool((json.loads(x).get("openAccessPdf") or {}).get("url")), pause=1.0, key_header="x-api-key", lenient=True),
}


def records(raw: DataFrame, service: str) -> DataFrame:
    """Records of raw items, under stable ids; items with neither abstract nor PDF are left out, and so are repeated ids."""
    c = _service(service).project(F.col("item"))
    shown = raw.select("query", "n", *[c[f].alias(f) for f in c]).withColumn("title", F.coalesce(_some(F.col("title")), F.lit("Untitled")))
    basis = F.coalesce(_some(F.col("fallback")), F.col("title")) if "fallback" in c else F.col("title")
    out = shown.where("abstract <> '' or pdf_url is not null").withColumns({
        "doi": S.normalize_doi(F.col("doi")), "year": S.clean_year(F.col("year")), "source": F.lit(service),
        "paper_id": S.paper_id(F.col("doi"), F.col("pmcid"), F.col("pmid"), basis),
    })
    return out.groupBy("paper_id").agg(F.min_by(F.struct(*FIELDS), F.struct("query", "n")).alias("r")).select("r.*")


def search(spark: SparkSession, service: str, query: str, limit: int = 20, **options: object) -> DataFrame:
    """Records of a service for a query (or several, one a line), at most ``limit`` of each."""
    register(spark, service)
    reader = spark.read.format(service).option("query", query).option("limit", str(limit))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return records(reader.load(), service)


# The data source ------------------------------------------------------------------------------------------------


def get(url: str, params: dict, tries: int = 5, wait: float = 0.0, headers: dict | None = None) -> bytes:
    """An answer, asked for again with growing pauses while the service is busy."""
    time.sleep(wait)
    asked = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}" if params else url, headers=headers or {})
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(asked, timeout=60) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if attempt == tries - 1 or e.code not in BUSY:
                raise
            after = e.headers.get("Retry-After")
            time.sleep(backoff(attempt, float(after) if after and after.isdigit() else None))
    raise AssertionError("unreachable")


@dataclass
class _Query(InputPartition):
    """A query with its recorded answers, if it is replayed; pages follow a cursor and stay together."""

    value: str
    recorded: list[bytes] | None = field(default=None)


class _Reader(DataSourceReader):
    def __init__(self, name: str, options: dict[str, str]) -> None:
        self.name, self.options = name, dict(options)
        if "query" not in self.options:
            raise ValueError("the option query is missing")

    def partitions(self) -> list[InputPartition]:
        queries = [q for q in self.options["query"].split("\n") if q.strip()]
        if "replay" not in self.options:
            return [_Query(q) for q in queries]
        # Recordings of query number i are in the folder i; of a single query they may be in the folder itself.
        root = Path(self.options["replay"])
        folders = [root / str(i) if (root / str(i)).is_dir() or len(queries) > 1 else root for i in range(len(queries))]
        return [_Query(q, [p.read_bytes() for p in sorted(f.iterdir()) if p.is_file()]) for q, f in zip(queries, folders)]

    def read(self, partition: _Query) -> Iterator[tuple]:
        service, key = _service(self.name), self.options.get("api_key")
        if partition.recorded is not None:
            answers = iter(partition.recorded)
            fetch = lambda url, params: next(answers)
        else:
            headers = {service.key_header: key} if key and service.key_header else {}
            extra = {service.key_param: key} if key and service.key_param else {}
            wait = float(self.options.get("delay", service.pause))
            fetch = lambda url, params: get(url, params | extra, wait=wait, headers=headers)
        for n, item in enumerate(items(service, partition.value, int(self.options.get("limit", 20)), fetch)):
            yield partition.value, n, item


def _source(service: str) -> type[DataSource]:
    class Literature(DataSource):
        @classmethod
        def name(cls) -> str:
            return service

        def schema(self) -> str:
            return RAW

        def reader(self, schema) -> DataSourceReader:
            return _Reader(service, self.options)

    return Literature


def _service(name: str) -> Service:
    if name not in SERVICES:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(SERVICES)}")
    return SERVICES[name]


def register(spark: SparkSession, *names: str) -> None:
    """Make the services known to ``spark.read``; all of them without names."""
    for name in names or SERVICES:
        _service(name)
        spark.dataSource.register(_source(name))


# PDF files ------------------------------------------------------------------------------------------------------


def download_pdfs(found: DataFrame, folder: str, fetch: Callable[[str], bytes] | None = None, enough: int = 1024) -> DataFrame:
    """(paper_id, path, problem): the PDF files of records, fetched into a folder that all executors share.

    A file of more than ``enough`` bytes that is there already is not fetched again. Without an address, or where the
    answer is no PDF or an error, ``path`` is null and ``problem`` says why.
    """
    ask = fetch or (lambda url: get(url, {}))

    @F.pandas_udf("struct<path:string,problem:string>")
    def fetched(names: pd.Series, urls: pd.Series) -> pd.DataFrame:
        rows = []
        for name, url in zip(names, urls):
            path = os.path.join(folder, f"{name}.pdf")
            if os.path.exists(path) and os.path.getsize(path) > enough:
                rows.append((path, None))
            elif not url:
                rows.append((None, "no address"))
            else:
                try:
                    content = ask(url)
                except OSError as e:
                    rows.append((None, f"not fetched: {e}"))
                    continue
                if content[:4] != b"%PDF":
                    rows.append((None, "no PDF"))
                    continue
                os.makedirs(folder, exist_ok=True)
                with open(f"{path}.part", "wb") as f:
                    f.write(content)
                os.replace(f"{path}.part", path)
                rows.append((path, None))
        return pd.DataFrame(rows, columns=["path", "problem"])

    return found.select("paper_id", fetched(S.safe_name(F.col("paper_id")), F.col("pdf_url")).alias("f")).select("paper_id", "f.*")


def search_and_download(spark: SparkSession, service: str, query: str, folder: str, limit: int = 20, fetch: Callable[[str], bytes] | None = None, **options: object) -> DataFrame:
    """Records with the path of their PDF file."""
    found = search(spark, service, query, limit, **options)
    return found.join(download_pdfs(found, folder, fetch), "paper_id", "left")
