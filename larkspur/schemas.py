"""Schemas of the relations; every relation whose order matters carries `pos`."""

ARTICLE = "article_id string, title string, url string, summary string, published_at timestamp, author string, source string, pos long"
GAME = "game_id long, start_time timestamp, status string, home_team string, away_team string, home_score int, away_score int, period int, home_periods array<int>, away_periods array<int>, pos long"
SEEN_ARTICLES = "article_id string, seen_at timestamp"
SEEN_GAMES = "state_hash string, game_id long, seen_at timestamp"
GAME_RESULTS = "game_id long, played_on date, home_team string, away_team string, home_score int, away_score int, status string"
TEAM = "struct<id:bigint,full_name:string>"
PERIODS = ("q1", "q2", "q3", "q4", "ot1", "ot2", "ot3")
RAW_GAME = (
    "id:bigint,date:string,datetime:string,status:string,period:int,season:int,home_team_score:int,visitor_team_score:int,"
    + "".join(f"{side}_{period}:int," for side in ("home", "visitor") for period in PERIODS)
    + f"home_team:{TEAM},visitor_team:{TEAM}"
)
RAW_GAMES = f"data array<struct<{RAW_GAME}>>"
RSS_ITEM = "guid string, title string, link string, description string, pubDate string, `dc:creator` string"
ATOM_ENTRY = "id string, title string, updated string, published string, link array<struct<_href:string>>, author struct<name:string>, content string"
