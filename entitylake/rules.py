"""Rule sets: the word lists and patterns that decide results.

All of them are defaults of generic operators; pass another instance to run the
same operator on other data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Results depend on these word lists and patterns exactly as given.
# ---------------------------------------------------------------------------

ARTIST_CATEGORIES = (
    "singers", "vocalists", "male singers", "female singers",
    "musicians", "instrumentalists", "multi-instrumentalists",
    "songwriters", "composers", "lyricists", "singer-songwriters",
    "record producers", "music producers", "hip hop producers",
    "djs", "disc jockeys", "turntablists",
    "rappers", "hip hop musicians", "mcs",
)
BAND_CATEGORIES = (
    "bands", "musical groups", "rock bands", "metal bands",
    "pop bands", "jazz bands", "boy bands", "girl groups",
    "musical duos", "duos",
)
ARTIST_TITLE_WORDS = (
    "singer", "vocalist", "musician", "songwriter", "composer", "producer", "dj", "rapper", "mc",
)
MUSIC_SIGNALS = ("music", "song", "album", "artist", "composer", "recording", "instrument")
OFF_TOPIC = (
    "telecommunication", "signal processing", "wireless", "broadband", "bandwidth",
    "radio technology", "internet", "networking", "legal", "marine", "railway",
    "physics", "engineering", "computer", "software", "television technology",
    "broadcasting", "spectrum management", "frequency", "radio spectrum",
)
MUSIC_INFOBOX = r"(?iU)\{\{\s*Infobox\s+(?:musical\s+artist|band|album|song|musical\s+work)"

FALSE_MATCH_PHRASES = (
    "greek gods", "roman gods", "greek deities", "roman deities",
    "mythological", "mythology",
    "biblical", "kings of israel", "monarchs", "pharaohs",
    "saints", "fictional characters", "television characters", "film characters",
)
PROTECTED_PHRASES = ("musical groups", "music groups", "rock groups", "hip-hop groups")
MUSIC_CATEGORY_WORDS = ("music", "singer", "song", "album", "band", "artist", "musician", "record")
MAX_CATEGORIES_WITHOUT_MUSIC = 5

INFOBOX_FIELDS = {
    "genre": "genre",
    "origin": "origin|birth_place",
    "years_active": "years_active",
    "label": "label",
    "members": "members|current_member_of",
    "birth_name": "birth_name",
}

# Profile page: field -> (pattern, group of the first match).
PROFILE_FIELDS = {
    "uuid": (r"/artist/([0-9a-f\-]{36})", 1),
    "name": (r"<h1><a[^>]*><bdi>([^<]+)</bdi></a>", 1),
    "comment": (r'<span class="comment">\(<bdi>([^<]+)</bdi>\)</span>', 1),
    "type": (r'<dd class="type">([^<]+)</dd>', 1),
    "founded": (r"(?iU)Founded:\s*([0-9\-]+)\s*in\s*([^,<>]+)", 1),
    "founded_in": (r"(?iU)Founded:\s*([0-9\-]+)\s*in\s*([^,<>]+)", 2),
    "area": (r'(?iU)Area:\s*([^,<>"\n]+)', 1),
    "isni_code": (r"(?i)isni\.org/([0-9X]+)", 1),
    "last_updated": (r'<p class="lastupdate">Last updated on ([^<]+)</p>', 1),
}
RATING_BLOCK = r'(?s)<h2 class="rating">.*?</p>'
RATING_VALUES = r'style="width:(\d+)%">([\d.]+)</span>'
PROFILE_LISTS = {
    "genres": r'(?s)<h3>Genres</h3><div class="genre-list">(.*?)</div>',
    "other_tags": r'(?s)<h3>Other tags</h3><div id="sidebar-tag-list">(.*?)</div>',
}
ANCHOR_TEXT = r"<a [^>]*>([^<]+)</a>"
EMPTY_LIST = r"(?i)\(none\)"

TABLE_ROW = r"(?s)<tr.*?</tr>"
# No ``.*?`` stands before an optional cell: what follows the cell is looked for from there on anyway,
# and a row without it would be searched once for each character.
RELEASE_ROW = (
    r'(?s)<a class="wrap-anywhere" href="([^"]+)"><bdi>([^<]+)</bdi></a>.*?'
    r"<td><bdi><a [^>]+>([^<]+)</a></bdi></td>.*?"
    r"<td>([^<]*)</td>.*?"
    r"<td>(\d+)</td>.*?"
    r'<abbr title="([^"]+)">.*?<span class="release-date">([^<]*)</span>.*?'
    r'<a href="[^"]+"><bdi>([^<]+)</bdi></a>'
    r'(?:<span class="catalog-number">([^<]+)</span>)?.*?'
    r'class="barcode-cell">([^<]*)</td>'
)
NO_BARCODE = "[none]"
RECORDING_ROW_START = "<tr"
RECORDING_ROW_MARK = "wrap-anywhere"
RECORDING_ROW = (
    r"(?s)<tr[^>]*>.*?"
    r'<a class="wrap-anywhere" href="([^"]+)"><bdi>([^<]+)</bdi></a>.*?'
    r"<td><bdi><a [^>]+>([^<]+)</a></bdi></td>"
    r'(?:<td class="c">.*?<span class="current-rating" style="width:\d+%">([\d.]+)</span>.*?</td>)?.*?'
    r"<td>([\d:]+)</td>.*?"
    r'<td>.*?<a href="[^"]+"><bdi>([^<]+)</bdi></a>'
)
RELATION_ROW = r"(?isU)<th[^>]*>([^<:]+):</th>\s*<td[^>]*>(.*?)</td>"
RELATION_PERSON = r'(?s)<a [^>]*href="(/artist/[^"]+)"[^>]*><bdi>([^<]+)</bdi></a>'
RELATION_DETAILS = r"\(([^)]+)\)"
RELATION_LABELS = ("members", "original_members", "artistic_directors")

ENTITY_LINK = r"/artist/([0-9a-f\-]{36})"
LISTED_TAG = r'(?s)<a href="/tag/([^"]+)">([^<]+)</a>.*?has been used ([\d,]+) times'

MIN_TAG_USES = 150_000
MAX_TAGS = 30
MAX_ENTITIES_PER_TAG = 100
MAX_FRONTIER = 3000
MAX_PAGES_PER_KIND = 5
PAGE_KINDS = ("profile", "releases", "recordings", "relationships")
PAGED_KINDS = ("releases", "recordings")

BM25_K1 = 1.2
BM25_B = 0.75
MAX_EDITS = 2

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class TypeRules:
    """Words and patterns that decide whether a page is an entity and of which type.

    ``types`` maps each type to its category phrases; the order is the order of
    precedence.  ``whole_word`` is evidence only together with a known category
    and, in a title, means ``whole_word_type``.
    """

    types: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("artist", ARTIST_CATEGORIES),
        ("band", BAND_CATEGORIES),
    )
    title_words: tuple[str, ...] = ARTIST_TITLE_WORDS
    title_words_type: str = "artist"
    whole_word: str = "band"
    whole_word_type: str = "band"
    signals: tuple[str, ...] = MUSIC_SIGNALS
    off_topic: tuple[str, ...] = OFF_TOPIC
    infobox: str = MUSIC_INFOBOX
    infobox_type: str = "artist"


@dataclass(frozen=True)
class FalseMatchRules:
    """Phrases in the categories that mark a linked record as a wrong match."""

    protected: tuple[str, ...] = PROTECTED_PHRASES
    wrong: tuple[str, ...] = FALSE_MATCH_PHRASES
    on_topic: tuple[str, ...] = MUSIC_CATEGORY_WORDS
    max_off_topic: int = MAX_CATEGORIES_WITHOUT_MUSIC


@dataclass(frozen=True)
class ProfileRules:
    """How scalar fields and tag lists are found in a profile page."""

    fields: dict[str, tuple[str, int]] = field(default_factory=lambda: dict(PROFILE_FIELDS))
    lists: dict[str, str] = field(default_factory=lambda: dict(PROFILE_LISTS))
