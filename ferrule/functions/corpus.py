"""Fixed value corpora for text columns (names, places, words).

Fixed values: each list below is used verbatim, indexed by a draw; changing an entry or its
position changes every generated dataset.
"""

FIRST_NAMES = [
    "Ada", "Alan", "Alice", "Amara", "Andre", "Anna", "Ben", "Bianca", "Carlos", "Chen",
    "Clara", "Dan", "Dara", "David", "Elena", "Emil", "Eva", "Farah", "Felix", "Grace",
    "Hana", "Hugo", "Ines", "Ivan", "Jade", "James", "Jonas", "Kai", "Kara", "Leo",
    "Lina", "Luis", "Maya", "Mei", "Mila", "Nadia", "Noah", "Omar", "Priya", "Quinn",
    "Rosa", "Sami", "Sara", "Tariq", "Theo", "Uma", "Vera", "Wen", "Yara", "Zoe",
]

LAST_NAMES = [
    "Abbott", "Baker", "Banda", "Castro", "Chen", "Cohen", "Costa", "Dubois", "Evans", "Fischer",
    "Garcia", "Gupta", "Haddad", "Hansen", "Ito", "Jensen", "Kaur", "Kim", "Kowalski", "Larsen",
    "Lopez", "Mbeki", "Meyer", "Moreau", "Nakamura", "Nguyen", "Novak", "Okafor", "Olsen", "Park",
    "Patel", "Perez", "Quist", "Rossi", "Sato", "Schmidt", "Silva", "Singh", "Smith", "Suzuki",
    "Tanaka", "Torres", "Ueda", "Varga", "Wagner", "Walker", "Weber", "Yilmaz", "Young", "Zhang",
]

CITIES = [
    "Amsterdam", "Athens", "Austin", "Bangalore", "Barcelona", "Berlin", "Bogota", "Boston",
    "Cairo", "Cape Town", "Chicago", "Copenhagen", "Dublin", "Helsinki", "Istanbul", "Jakarta",
    "Kyoto", "Lagos", "Lima", "Lisbon", "London", "Lyon", "Madrid", "Manila", "Melbourne",
    "Montreal", "Mumbai", "Nairobi", "Oslo", "Porto", "Prague", "Seoul", "Seville", "Toronto",
    "Valencia", "Vienna", "Warsaw", "Zurich",
]

COUNTRIES = [
    "Argentina", "Australia", "Austria", "Brazil", "Canada", "Chile", "Colombia", "Denmark",
    "Egypt", "Finland", "France", "Germany", "Greece", "India", "Indonesia", "Ireland", "Italy",
    "Japan", "Kenya", "Mexico", "Netherlands", "Nigeria", "Norway", "Peru", "Philippines",
    "Poland", "Portugal", "South Africa", "South Korea", "Spain", "Sweden", "Switzerland",
    "Turkey", "United Kingdom", "United States", "Vietnam",
]

STREETS = [
    "Acacia", "Birch", "Cedar", "Chestnut", "Elm", "Hawthorn", "Hazel", "Juniper", "Laurel",
    "Linden", "Maple", "Oak", "Olive", "Pine", "Poplar", "Rowan", "Spruce", "Willow",
]

STREET_SUFFIXES = ["Avenue", "Court", "Drive", "Lane", "Place", "Road", "Street", "Way"]

COMPANY_SUFFIXES = ["Group", "Holdings", "Industries", "Labs", "Partners", "Systems", "Trading",
                    "Works"]

EMAIL_DOMAINS = ["example.com", "example.net", "example.org", "mail.test", "inbox.test"]

TLDS = ["com", "net", "org", "io", "dev", "test"]

# Exactly 64 words: a sentence takes six bits of a draw per word.
WORDS = [
    "amber", "anchor", "apple", "arrow", "autumn", "basil", "beacon", "birch",
    "bloom", "breeze", "canyon", "cedar", "cinder", "cloud", "comet", "copper",
    "coral", "crystal", "dawn", "delta", "dune", "ember", "falcon", "fern",
    "field", "flint", "forest", "frost", "garden", "glacier", "granite", "harbor",
    "hazel", "horizon", "island", "ivory", "jasper", "lagoon", "lantern", "maple",
    "meadow", "mist", "moss", "nectar", "oasis", "ocean", "orchid", "pebble",
    "pine", "prairie", "quartz", "raven", "reef", "river", "saffron", "shadow",
    "spruce", "stone", "summit", "thistle", "timber", "valley", "willow", "zephyr",
]
