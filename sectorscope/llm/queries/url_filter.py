"""Verdicts on the URLs of pages.  A trained model has no SQL."""

from __future__ import annotations

from sectorscope.llm.queries.registry import query, table
from sectorscope.llm.url_filter import judge
from sectorscope.operators.sizing import local_table

RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]

# Hosts that a reviewer would block, and hosts of ordinary sites.
BLOCKED = """
casino-royal casino-slots lucky-casino casino-win-big win-casino online-casino-bonus
cheap-pills-shop buy-pills pills-cheap cheap-meds cheap-pills-online diet-pills-now
free-bets-club best-bets sport-bets bets-free-daily bets-online free-bets-now
adult-cams adult-x-videos x-adult adult-dating adult-chat-x hot-adult
spam-farm-links link-farm spam-links seo-spam farm-spam spam-farm-net
ads-track-pixel track-ads ads-clicks ads-tracker click-track ads-server-track
""".split()
ALLOWED = """
library history science weather gardening museum recipes university
theatre letters otherside ranger tinker fishing nations inland
northern athletics weather-station theory thesis thread mother-tongue tions
townhall river-walk bird-watch open-books city-news old-maps school-band green-house
ththere thereon thrive therapy thions tional
""".split()
PREFIXES = ("", "www.", "blog.", "m.")
ENDS = ("com", "net", "org")
LANGUAGES = ("en", "de", "fr", "es")
PAGES = ("12", "345/", "67.html", "890#top")


def labelled_urls(spark):
    """The small labelled table: label 1 is to be blocked.  Everything but the name is dealt alike."""
    rows = []
    for label, names in ((1, BLOCKED), (0, ALLOWED)):
        for k, name in enumerate(names):
            host = f"{PREFIXES[k % 4]}{name}.example.{ENDS[k % 3]}"
            rows.append((f"https://{host}/{LANGUAGES[k // 2 % 4]}/{PAGES[k // 3 % 4]}", label))
    return local_table(spark, rows, "url string, label int")


@query()
def op12_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled_urls(spark), RULES).select("page_id", "host", "path", "rule", "verdict", "score")
