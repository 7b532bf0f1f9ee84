"""Fixed values that must equal the reference's for the same results.

Category groups and the blocked-category list are *inputs*: the functions in
``operators`` take them as tables, and these defaults only seed those tables.

Decisions (see README): list entries that the reference fuses through a
missing comma are given here as the two separate names they were meant to be;
``beer, wine & spirits`` is listed together with its two tokens ``beer`` and
``wine & spirits`` (a ``', '`` split can never produce the joined name); an
entry listed twice in the reference (``tea rooms``) is listed once.
"""

# ---- fixed values: categories that remove a business (lower case) ----
BLOCKED_CATEGORIES = [
    "automotive", "gas stations", "fashion", "hotels & travel", "cosmetics & beauty supply", "home & garden",
    "photography stores & services", "electronics", "furniture stores", "tobacco shops", "education",
    "home services", "mobile phones", "home decor", "bookstores", "appliances", "hardware stores", "vape shops",
    "head shops", "religious organizations", "party supplies", "public services & government", "medical centers",
    "community service/non-profit", "tires", "sporting goods", "eyewear & opticians", "hobby shops",
    "nurseries & gardening", "fitness & instruction", "real estate", "financial services", "lawyers", "insurance",
    "shipping centers", "professional services", "shopping centers", "food court", "wholesale stores",
    "dance clubs", "hookah bars", "massage", "local services", "international grocery", "farmers market",
    "department stores", "beauty & spas", "health & medical", "convenience stores",
]

# ---- fixed values: category groups -> member categories (lower case) ----
CATEGORY_GROUPS = {
    "has_american": ["american (traditional)", "american (new)", "diners", "steakhouses", "hot dogs", "comfort food",
                     "southern", "bbq", "new american", "breakfast & brunch", "buffets", "chicken wings",
                     "cajun/creole", "gastropubs", "meat shops", "food stands", "food trucks"],
    "has_asian_food": ["japanese", "chinese", "sushi bars", "asian fusion", "korean", "indian", "vietnamese", "thai",
                       "laotian", "malaysian", "mongolian", "taiwanese", "cantonese", "dim sum", "hot pot",
                       "filipino", "singaporean", "szechuan", "ramen"],
    "has_hispanic_food": ["mexican", "tex-mex", "spanish", "puerto rican", "cuban", "colombian", "salvadoran",
                          "argentine", "peruvian", "brazilian", "venezuelan", "dominican", "guatemalan", "honduran",
                          "empanadas", "latin american", "new mexican cuisine"],
    "has_european_food": ["italian", "french", "german", "greek", "mediterranean", "spanish", "portuguese",
                          "austrian", "belgian", "hungarian", "irish", "scandinavian", "swiss", "russian", "polish",
                          "pasta", "modern european"],
    "has_seafood": ["seafood", "seafood markets", "fish & chips", "poke"],
    "serves_alcohol": ["beer, wine & spirits", "beer", "wine & spirits", "pubs", "cocktail bars", "wine bars",
                       "beer bar", "breweries", "wineries", "brewpubs", "beer tours", "wine tours", "distilleries",
                       "whiskey bars", "wine tasting classes", "irish pub"],
    "has_vegetarian": ["vegan", "vegetarian"],
    "has_entertainment": ["arts & entertainment", "music venues", "karaoke", "dinner theatre", "piano bars"],
    "has_coffee_or_tea": ["coffee & tea", "bubble tea", "tea rooms", "coffee roasteries"],
    "serves_sweets": ["desserts", "ice cream & frozen yogurt", "bakeries", "donuts", "cupcakes",
                      "chocolatiers & shops", "shaved_ice", "gelato", "creperies", "patisserie/cake shop",
                      "candy stores", "custom cakes"],
}
GROUP_NAMES = list(CATEGORY_GROUPS)

# ---- fixed values: generic categories left out of a user's category counts ----
GENERIC_CATEGORIES = ["food", "restaurants"]

# ---- fixed values: business attributes promoted to columns ----
PROMOTED_ATTRIBUTES = ["DogsAllowed", "Music", "OutdoorSeating", "RestaurantsPriceRange2", "BusinessParking", "Ambience", "Open24Hours"]
# promoted attributes whose missing value becomes False (with the ten group flags)
IMPUTED_ATTRIBUTES = ["DogsAllowed", "Open24Hours"]

# ---- fixed values: hidden-gem score ----
GEM_WEIGHTS = {"sentiment": 0.30, "volume": 0.25, "local_preference": 0.20, "quality": 0.25}
GEM_GOOD_RATING = 3.5      # avg stars at/above which sentiment and quality count fully
GEM_VOLUME_SCALE = 200.0   # volume_score = exp(-n / 200)
GEM_LOCAL_EXPONENT = 1.5   # local_preference_score = local_ratio ** 1.5
EARTH_RADIUS_MILES = 3959.0

# ---- fixed values: ranking metrics ----
RELEVANCE_THRESHOLD = 3.5
METRIC_KS = [5, 10, 20, 30, 50]

# ---- fixed values: bias baseline (alternating shrunk means) ----
BASELINE_REG_ITEM = 10.0
BASELINE_REG_USER = 15.0

# ---- fixed values: model feature columns (names and order) ----
BUSINESS_NUMERIC = ["latitude", "longitude", "stars", "review_count", "num_tips", "num_checkins",
                    "RestaurantsPriceRange2", "avg_sentiment", "local_preference_ratio", "elite_user_ratio"]
BUSINESS_CATEGORICAL = ["city", "state", "is_open", "has_coffee_or_tea", "serves_sweets", "serves_alcohol",
                        "DogsAllowed", "has_european_food", "has_american", "has_asian_food", "has_seafood",
                        "has_entertainment", "has_hispanic_food", "has_vegetarian", "Open24Hours"]
USER_CATEGORICAL = ["base_city", "state_code", "top_category", "elite"]
USER_NUMERIC = ["review_count", "useful", "funny", "cool", "fans", "average_stars", "compliment_hot",
                "compliment_more", "compliment_profile", "compliment_cute", "compliment_list", "compliment_note",
                "compliment_plain", "compliment_cool", "compliment_funny", "compliment_writer", "compliment_photos",
                "avg_sentiment", "top_category_ratio", "has_american_ratio", "has_asian_food_ratio",
                "has_hispanic_food_ratio", "has_european_food_ratio", "has_seafood_ratio", "serves_alcohol_ratio",
                "has_vegetarian_ratio", "has_entertainment_ratio", "has_coffee_or_tea_ratio", "serves_sweets_ratio",
                "years_elite", "rating_variance", "local_review_ratio", "days_since_last_review",
                "review_frequency", "avg_price_preference", "num_cities_reviewed"]
# order of a new user's feature vector
NEW_USER_VECTOR = USER_NUMERIC + ["base_city_encoded", "state_code_encoded", "top_category_encoded",
                                       "elite_encoded", "days_yelping"]

# ---- fixed values: rule-based sentiment (constants of the published VADER method) ----
SENT_NEGATION_SCALAR = -0.74
SENT_BOOST_INCREMENT = 0.293
SENT_BOOST_DECAY = [1.0, 0.95, 0.9]      # booster 1, 2 or 3 words before the scored word
SENT_BUT_BEFORE, SENT_BUT_AFTER = 0.5, 1.5
SENT_CAPS_INCREMENT = 0.733
SENT_EXCLAMATION_STEP, SENT_EXCLAMATION_MAX = 0.292, 4
SENT_QUESTION_STEP, SENT_QUESTION_MAX = 0.18, 0.96
SENT_NORMALIZATION_ALPHA = 15.0
NEGATION_WORDS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't", "can't",
    "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt",
    "neither", "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't", "neednt", "needn't",
    "never", "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "uhuh",
    "wasnt", "werent", "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't", "without", "wont",
    "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite",
]
BOOSTER_UP = [
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly", "deeply",
    "effing", "enormous", "enormously", "entirely", "especially", "exceptional", "exceptionally", "extreme",
    "extremely", "fabulously", "flipping", "flippin", "frackin", "fracking", "fricking", "frickin", "frigging",
    "friggin", "fully", "fuckin", "fucking", "fuggin", "fugging", "greatly", "hella", "highly", "hugely",
    "incredible", "incredibly", "intensely", "major", "majorly", "more", "most", "particularly", "purely",
    "quite", "really", "remarkably", "so", "substantially", "thoroughly", "total", "totally", "tremendous",
    "tremendously", "uber", "unbelievably", "unusually", "utter", "utterly", "very",
]
BOOSTER_DOWN = [
    "almost", "barely", "hardly", "kind of", "kinda", "kindof", "kind-of", "less", "little", "marginal",
    "marginally", "occasional", "occasionally", "partly", "scarce", "scarcely", "slight", "slightly", "somewhat",
    "sort of", "sorta", "sortof", "sort-of",
]
