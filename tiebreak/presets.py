"""Fixed values for one league, usable as default dimensions.

Nothing in the operators depends on them; every operator takes its roster,
aliases, team table and season range as arguments.
"""

# The roster of the forecast season, in list order.
ROSTER = [
    "Mumbai Indians",
    "Chennai Super Kings",
    "Royal Challengers Bengaluru",
    "Kolkata Knight Riders",
    "Delhi Capitals",
    "Rajasthan Royals",
    "Sunrisers Hyderabad",
    "Punjab Kings",
    "Lucknow Super Giants",
    "Gujarat Titans",
]

# Lower-case feed names and the names the history uses.
ALIASES = {
    "rcb": "Royal Challengers Bengaluru",
    "royal challengers bangalore": "Royal Challengers Bengaluru",
    "royal challengers bengaluru": "Royal Challengers Bengaluru",
    "mi": "Mumbai Indians",
    "csk": "Chennai Super Kings",
    "kkr": "Kolkata Knight Riders",
    "dc": "Delhi Capitals",
    "rr": "Rajasthan Royals",
    "srh": "Sunrisers Hyderabad",
    "pbks": "Punjab Kings",
    "lsg": "Lucknow Super Giants",
    "gt": "Gujarat Titans",
    "kings xi punjab": "Punjab Kings",
    "delhi daredevils": "Delhi Capitals",
}

# Team name, short label, colour; the first matching row wins.
TEAM_DIM = [
    ("Mumbai Indians", "MI", "#004BA0"),
    ("Chennai Super Kings", "CSK", "#F9CD05"),
    ("Royal Challengers Bengaluru", "RCB", "#EC1C24"),
    ("Royal Challengers Bangalore", "RCB", "#EC1C24"),
    ("Kolkata Knight Riders", "KKR", "#3A225D"),
    ("Delhi Capitals", "DC", "#00008B"),
    ("Delhi Daredevils", "DD", "#00008B"),
    ("Rajasthan Royals", "RR", "#EA1A85"),
    ("Sunrisers Hyderabad", "SRH", "#F7A721"),
    ("Punjab Kings", "PBKS", "#ED1B24"),
    ("Kings XI Punjab", "KXIP", "#ED1B24"),
    ("Lucknow Super Giants", "LSG", "#A2D4F5"),
    ("Gujarat Titans", "GT", "#1C4C8C"),
    ("Deccan Chargers", "DC", "#555555"),
    ("Pune Warriors", "PW", "#8B4513"),
    ("Rising Pune Supergiant", "RPS", "#6A0DAD"),
    ("Rising Pune Supergiants", "RPS", "#6A0DAD"),
    ("Gujarat Lions", "GL", "#FF6600"),
]
DEFAULT_COLOR = "#FF6B1A"

# Search spaces, full and quick.
SEARCH_SPACE = {
    "n_estimators": [100, 200, 300, 500],
    "max_depth": [3, 4, 5, 6],
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "subsample": [0.6, 0.8, 1.0],
    "colsample_bytree": [0.6, 0.8, 1.0],
    "min_child_weight": [1, 3, 5],
    "gamma": [0, 0.1, 0.3],
}
QUICK_SEARCH_SPACE = {
    "n_estimators": [200, 300],
    "max_depth": [4, 5],
    "learning_rate": [0.05, 0.1],
    "subsample": [0.8, 1.0],
}
