"""Configuration: fixed values that must equal the reference's for equal results.

Everything below the FIXED VALUES marker is stated plainly, in natural order,
as the reference defines it.  Operators take these as default arguments, so a
caller can pass other lists (tests do, see ``TEST_FILTERS``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference; do not edit for convenience)
# ---------------------------------------------------------------------------

# Tool / software tags: an app carrying any of these is not a game.
TOOL_TAGS = [
    "Software",
    "Utilities",
    "Animation & Modeling",
    "Design & Illustration",
    "Video Production",
    "Web Publishing",
    "Education",
    "Accounting",
    "Photo Editing",
    "Audio Production",
    "Game Development",
]

# Tags never shown as busy niches: the tool tags plus these.
OTHER_NON_GAME_TAGS = [
    "NSFW",
    "Sexual Content",
    "Nudity",
    "Hentai",
    "Documentary",
    "Short",
    "Movie",
    "Episodic",
    "Tutorial",
]

# Known non-game app ids (Wallpaper Engine, Blender).
NON_GAME_APP_IDS = [431960, 365670]

# Name patterns of non-games (case-insensitive, delimited words).
NON_GAME_NAME_WORDS = r"(SDK|Soundtrack|Dedicated\s+Server|Playtest)"
WALLPAPER_NAME = r"Wallpaper\s+Engine"

# Exact tag name that marks free-to-play in the free-game fallback.
F2P_TAG = "Free to Play"

# Sentiment lexicon.
POSITIVE_WORDS = (
    "amazing awesome best beautiful brilliant enjoyable excellent fun great love "
    "loved masterpiece polished recommend solid stunning wonderful"
).split()
NEGATIVE_WORDS = (
    "awful bad boring broken bug bugs crash crashes disappointing hate hated lag "
    "poorly refund shit terrible trash unplayable worst"
).split()

# Official store genres (matched against genres.genre_name).
OFFICIAL_GENRES = [
    "Action", "Indie", "Adventure", "RPG", "Strategy", "Simulation", "Casual",
    "Sports", "Racing", "Massively Multiplayer", "Free To Play", "Early Access",
]

# Niche tags (not store genres).
NICHE_TAGS = [
    "Horror", "Metroidvania", "Roguelike", "Souls-like", "Puzzle", "Platformer",
    "Survival", "Multiplayer", "Shooter", "FPS", "Open World", "Sandbox", "JRPG",
    "MMORPG", "Visual Novel", "Fighting", "Stealth", "Action RPG",
    "Survival Horror", "RTS", "Grand Strategy", "Turn-Based Strategy", "MOBA",
    "Battle Royale", "Hack and Slash", "Point & Click", "Dungeon Crawler",
    "Tower Defense", "Card Game", "City Builder", "Management", "Action-Adventure",
]

# Tag alias folding for niche lists (display name -> spellings).
NICHE_ALIASES = {
    "Roguelike": ["Roguelike", "Rogue-like", "Roguelite", "Rogue-lite"],
}

# Leaderboard category aliases.
CATEGORY_ALIASES = {
    "Roguelike": ["Roguelike", "Rogue-like", "Roguelite", "Rogue-lite"],
    "Free To Play": ["Free To Play", "Free to Play"],
}

# Major genres of the analysis page: official ones, then niche tags.
MAJOR_OFFICIAL_GENRES = [
    "Action", "Adventure", "RPG", "Strategy", "Simulation", "Indie", "Casual",
    "Sports", "Racing",
]
MAJOR_NICHE_GENRES = ["Horror", "Shooter", "Multiplayer", "Survival", "Puzzle", "Platformer"]

# Leaderboard arguments.
LEADERBOARD_SORTS = ["ccu", "owners", "recommend", "least_recommend", "reviews", "playtime", "name"]
LEADERBOARD_PRICES = ["all", "free", "paid", "under5", "5to15", "15to30", "over30"]
LEADERBOARD_LIMITS = [25, 50, 100]
LEADERBOARD_DEFAULT_LIMIT = 50
MIN_REVIEWS_FOR_RECOMMEND = 20
MAX_MIN_CCU = 1_000_000

# List-price buckets: (upper bound exclusive, label, sort key); last is open.
PRICE_BUCKETS = [
    (5, "$0–5", 1),
    (10, "$5–10", 2),
    (20, "$10–20", 3),
    (40, "$20–40", 4),
    (60, "$40–60", 5),
    (None, "$60+", 6),
]

# Review fetch quota by snapshot rank: (rank upper bound exclusive, pages, per page).
REVIEW_QUOTA = [
    (10, 5, 100),
    (50, 2, 100),
    (200, 1, 100),
    (1000, 1, 50),
    (None, 1, 8),
]

# Studio hierarchy seed: parent -> children.
STUDIO_SEED = {
    "Activision Blizzard": ["Infinity Ward", "Treyarch", "Blizzard Entertainment", "Activision", "Beenox", "Sledgehammer Games"],
    "Electronic Arts": ["EA DICE", "DICE", "BioWare", "Respawn Entertainment", "Criterion Games", "PopCap Games"],
    "Ubisoft": ["Ubisoft Montreal", "Ubisoft Toronto", "Ubisoft Paris", "Ubisoft Quebec", "Ubisoft Bordeaux", "Ubisoft Sofia", "Massive Entertainment"],
    "Xbox Game Studios": ["Bethesda Softworks", "id Software", "Playground Games", "Ninja Theory", "Obsidian Entertainment", "Double Fine Productions"],
    "Take-Two Interactive": ["Rockstar Games", "Rockstar North", "2K", "2K Games", "Hangar 13", "Visual Concepts"],
    "Embracer Group": [],
    "Sony Interactive Entertainment": [],
}

# Path separators of the studio tree (analysis SQL, signals page).
TREE_SEPARATOR = " > "
TREE_SEPARATOR_SIGNALS = " › "

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------


def lower_all(xs):
    return [x.lower() for x in xs]


@dataclass(frozen=True)
class Filters:
    """Denylists used by the real-game and relevant-tag predicates."""

    tool_tags: tuple = tuple(lower_all(TOOL_TAGS))
    non_game_tags: tuple = tuple(lower_all(TOOL_TAGS + OTHER_NON_GAME_TAGS))
    app_ids: tuple = tuple(NON_GAME_APP_IDS)

    def with_tool_tags(self, extra):
        extra = tuple(lower_all(extra))
        return Filters(self.tool_tags + extra, self.non_game_tags + extra, self.app_ids)


DEFAULT_FILTERS = Filters()

# The synthetic test tables carry none of the real tool tags; two test tags
# make the real-game filter do work on them.
TEST_TOOL_TAGS = ["Brand#13", "old"]
TEST_FILTERS = DEFAULT_FILTERS.with_tool_tags(TEST_TOOL_TAGS)


@dataclass(frozen=True)
class Clock:
    """'now' for trailing windows; an argument so results are reproducible."""

    snapshots: str = "2001-11-05 00:00:00"
    reviews: str = "2024-01-31 00:00:00"


TEST_CLOCK = Clock()
