"""Defaults of the jobs' parameters and the fixed values they share."""

MIN_CHARS, MIN_WORDS = 5, 3
NEAR_DUPLICATE, SHINGLE_WORDS = 0.85, 3
CONFIDENCE = 0.7
WINDOW_DAYS, MIN_CLUSTER = 30, 3
PRIORITY_WEIGHTS = {"volume": 0.3, "velocity": 0.3, "sentiment": 0.2, "rating_impact": 0.2}
CHUNK_MAX, BULLET_MIN, PARAGRAPH_OVER = 500, 10, 40
SIMILARITY, VECTOR_K, BM25_K, RRF_K, FUSED_K, RERANK_N = 0.3, 8, 8, 60, 12, 5
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
KEYWORDS, CLUSTER_KEYWORDS, SAMPLES, SAMPLE_CHARS, PREVIEW_CHARS = 20, 10, 5, 300, 80

# The label sets, feed name, stop words and stripped characters that results depend on.
CATEGORIES = [
    "technical_issues", "performance_optimization", "gameplay_mechanics", "balance_difficulty", "ui_controls",
    "content_progression", "multiplayer_network", "story_presentation", "monetization_value", "other",
]
RETRIEVAL_CATEGORIES = CATEGORIES[:-1]
TONES = ["frustrated", "angry", "sarcastic", "constructive", "neutral", "disappointed", "confused", "appreciative"]
NEWS_TYPES = ["patch", "content_update", "event"]
DEFAULT_FEED = "steam_community_announcements"
WORD_EDGE = ".,!?;:\"'()[]{}#@*&^%$~`<>/\\|+=-_"
STOP_WORDS = (
    "the a an is it in to and of for on with this that was are you but not have has had be been can will would just so its my me i do if at by "
    "or no from they we there all your what when up out about how one their very really more some than get got like don as im ive also even much too "
    "don't dont can't cant won't wont isn't isnt didn't didnt doesn't doesnt it's i'm i've you're youre that's thats there's theres "
    "am did does should could may might must he she him her them us who which because "
    "game games played playing being time hours play best ever every great love good amazing first after fun then only go again most see still "
    "where feel other made into feels way many better any want lot make over well run runs experience while back each new different bit "
    "say never makes everything now recommend full know nice bad here think enjoy why win though masterpiece try addictive addicting second "
    "third fourth fifth sixth seventh eighth ninth tenth since years year day days month months own need something worth his hers theirs "
    "ours hate minute minutes seconds beat pew end players player people die dead find start lose things give gave main far near thing going used "
    "uses use few around work works worked overall once doing add enjoyed looking plenty take takes taken took"
).split()
