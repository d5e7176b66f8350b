"""Word lists, thresholds, names and formats. All are parameters of the operators that use them."""

# Fixed values ---------------------------------------------------------------------------------------------------
REJECTED_TAGS = ("highlight", "highlights", "oc", "original content", "image", "video", "gif", "meme", "humor", "discussion", "serious", "question", "poll", "misc", "off topic", "throwback", "retrospective")
RETROSPECTIVE_PHRASES = ("on this day", "years ago", "throwback", "flashback", "remember when", "this day in", "during his career", "during his nba career", "in his career", "career retrospective")
COMMUNITY_SOURCES = ("r/nba",)
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
MAX_AGE_HOURS = 168
MAX_OPINION_WORDS = 12
HIGH_WORDS = ("sign", "signs", "signed", "signing", "re-up", "re-ups", "extension", "extends", "trade", "trades", "traded", "waive", "waived", "release", "released", "acquire", "acquired", "joins", "landed", "leaving", "departure", "exits", "hired", "fired", "injury", "injured", "surgery", "sidelined", "returns", "cleared", "suspended", "suspension", "retires", "retirement", "agency", "agent", "contract", "deal", "pursuit")
LOW_WORDS = ("wedding", "married", "marries", "knot", "engaged", "fiancee", "fiancée", "divorce", "girlfriend", "boyfriend", "instagram", "tiktok", "podcast", "restaurant", "fashion", "album", "romance")
NOT_NAMES = ("the", "a", "an", "in", "on", "of", "for", "and", "but", "per", "why", "how", "what", "when", "who", "nba", "breaking", "sources", "report", "reportedly", "source", "new", "his", "her", "this", "that", "it", "is", "was", "after", "before", "with", "from", "says", "said", "first", "last", "next", "one", "two")
SENTENCE_STARTERS = ("in", "on", "at", "the", "a", "an", "and", "but", "for", "with", "after", "before", "meanwhile", "elsewhere", "also", "however", "while", "as", "by", "from", "to", "of", "this", "that", "these", "those", "his", "her", "their")
COMPETITION_WORDS = ("nba", "wnba", "nbpa", "league", "conference", "conferences", "division", "divisions", "eastern", "western", "east", "west", "atlantic", "central", "southeast", "northwest", "pacific", "southwest", "playoff", "playoffs", "postseason", "finals", "semifinals", "quarterfinals", "play-in", "in-season", "tournament", "cup", "collective", "bargaining", "agreement", "summer", "draft", "lottery", "combine", "weekend", "all-star", "all-nba", "all-defensive", "all-rookie", "mvp", "rookie", "team", "game")
TEAM_NAMES = (("76ers", "sixers", "sixer"), ("cavaliers", "cavs"), ("timberwolves", "wolves", "twolves", "t-wolves"), ("mavericks", "mavs"), ("knicks", "knick"), ("thunder", "okc"), ("nuggets", "nugs"), ("grizzlies", "grizz"), ("pelicans", "pels"), ("warriors", "dubs"))
ABBREVIATIONS = {"madison square garden": ("msg",), "karl-anthony towns": ("kat",)}
TRAILING = ',;:!?()[]{}"“”«»…'
SEPARATORS = ",;:"
SIMILAR_TITLES = 0.85
RARE_SHARE, RARE_FLOOR, SHARED_NAMES = 0.08, 5, 2
SOURCE_LIMITS, SOURCE_LIMIT = {"r/nba": 3}, 4
MAX_STORIES, SUMMARY_CHARS, MESSAGE_CHARS, CHUNK, MIN_SUMMARY_CHARS = 12, 256, 4096, 5, 60
CATEGORIES = ("comeback", "overtime", "closest_finish", "wire_to_wire", "second_half_takeover", "biggest_period", "largest_margin", "highest_scoring")
CATEGORY_LABELS = {"comeback": "Comeback", "overtime": "Overtime", "closest_finish": "Close finish", "wire_to_wire": "Wire to wire", "second_half_takeover": "Second-half takeover", "biggest_period": "Big quarter", "largest_margin": "Big win", "highest_scoring": "High scoring"}
BLOWOUT, CLOSE, HIGH_TOTAL, COMEBACK, BIG_PERIOD, SWING = 20, 5, 250, 15, 40, 20
FEEDS = ("espn", "cbs", "yahoo", "r/nba")
ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
SCORES_HEAD, NOTABLE_HEAD, NEWS_HEAD, MARK = "🏀 SCORES", "📊 NOTABLE", "📰 NEWS", "⚠️"
MESSAGE_SEPARATOR = "\n---\n"
FIGURE = r"(\$\s?[\d,.]+\s?(?:million|billion|[MBK])?|\b\d[\d,.]*\s?(?:million|billion)\b)"
PREAMBLE = r"^(here (is|are)|in (nba|the nba) news|the nba (offseason|season)\b)"
LEGEND = "{mark} these names never appear in the same source article, so the link between them is not something the sources reported."
MISSING = "Missing this run: {names}. Those stories are not in the brief."
SUBMITTED_BY = r"(?is)submitted by\s*/u/\S+.*$"
BRIEF_CHARS, ATTEMPTS = 1024, 3
ITEMS_HEAD = "Summarise the following {n} NBA news items in at most {most} characters."
NOTES_HEAD = "Write the brief from these {n} notes, in at most {most} characters. All {n} notes must appear in your answer — combine related ones into a single sentence rather than leaving any out. The notes are already in priority order; keep that order. Write one continuous piece of prose."
# ----------------------------------------------------------------------------------------------------------------
