"""Place names that reveal a country of origin. Order matters: the first entry of a list wins."""

# Indian states and union territories as written on labels.
STATES = {
    "andhra pradesh": "Andhra Pradesh", "arunachal pradesh": "Arunachal Pradesh", "assam": "Assam", "bihar": "Bihar",
    "chhattisgarh": "Chhattisgarh", "goa": "Goa", "gujarat": "Gujarat", "haryana": "Haryana",
    "himachal pradesh": "Himachal Pradesh", "jharkhand": "Jharkhand", "karnataka": "Karnataka", "kerala": "Kerala",
    "madhya pradesh": "Madhya Pradesh", "maharashtra": "Maharashtra", "manipur": "Manipur", "meghalaya": "Meghalaya",
    "mizoram": "Mizoram", "nagaland": "Nagaland", "odisha": "Odisha", "orissa": "Odisha", "punjab": "Punjab",
    "rajasthan": "Rajasthan", "sikkim": "Sikkim", "tamil nadu": "Tamil Nadu", "tamilnadu": "Tamil Nadu",
    "telangana": "Telangana", "tripura": "Tripura", "uttar pradesh": "Uttar Pradesh", "uttarakhand": "Uttarakhand",
    "uttaranchal": "Uttarakhand", "west bengal": "West Bengal", "delhi": "Delhi", "new delhi": "Delhi",
    "national capital region": "Delhi", "ncr": "Delhi", "chandigarh": "Chandigarh", "puducherry": "Puducherry",
    "pondicherry": "Puducherry", "jammu and kashmir": "Jammu & Kashmir", "jammu & kashmir": "Jammu & Kashmir",
    "ladakh": "Ladakh", "andaman and nicobar": "Andaman & Nicobar", "dadra and nagar haveli": "Dadra & Nagar Haveli",
    "daman and diu": "Daman & Diu", "lakshadweep": "Lakshadweep",
}

# Postal abbreviations of the states.
STATE_CODES = {
    "AP": "Andhra Pradesh", "AR": "Arunachal Pradesh", "AS": "Assam", "BR": "Bihar", "CG": "Chhattisgarh", "GA": "Goa",
    "GJ": "Gujarat", "HR": "Haryana", "HP": "Himachal Pradesh", "JH": "Jharkhand", "KA": "Karnataka", "KL": "Kerala",
    "MP": "Madhya Pradesh", "MH": "Maharashtra", "MN": "Manipur", "ML": "Meghalaya", "MZ": "Mizoram", "NL": "Nagaland",
    "OD": "Odisha", "PB": "Punjab", "RJ": "Rajasthan", "SK": "Sikkim", "TN": "Tamil Nadu", "TS": "Telangana",
    "TR": "Tripura", "UP": "Uttar Pradesh", "UK": "Uttarakhand", "UA": "Uttarakhand", "WB": "West Bengal", "DL": "Delhi",
    "CH": "Chandigarh", "PY": "Puducherry", "JK": "Jammu & Kashmir", "LA": "Ladakh",
}

# Cities and industrial towns by state.
CITIES_BY_STATE = {
    "Haryana": ["rewari", "bawal", "sonipat", "sonepat", "barhi", "kundli", "panipat", "gurgaon", "gurugram", "faridabad",
                "manesar", "dharuhera", "rohtak", "ambala", "karnal", "hisar"],
    "Maharashtra": ["mumbai", "bombay", "pune", "thane", "navi mumbai", "raigad", "taloja", "nagpur", "nashik", "aurangabad",
                    "kolhapur", "solapur", "bhiwandi", "vile parle", "andheri"],
    "Karnataka": ["bengaluru", "bangalore", "hubli", "hubballi", "dharwad", "mysuru", "mysore", "mangalore", "mangaluru",
                  "belgaum", "belagavi", "bailhongal", "ballari", "bellary", "karignoor", "hospet", "sankalapur"],
    "Tamil Nadu": ["chennai", "madras", "coimbatore", "madurai", "tiruchirappalli", "salem", "tiruppur", "erode", "nilakottai",
                   "batlagundu", "dindigul", "ambattur", "sriperumbudur", "hosur"],
    "Gujarat": ["ahmedabad", "surat", "vadodara", "baroda", "rajkot", "bhavnagar", "vapi", "ankleshwar", "sanand", "anand",
                "gandhinagar"],
    "Uttar Pradesh": ["noida", "greater noida", "ghaziabad", "kanpur", "lucknow", "agra", "varanasi", "meerut", "bareilly",
                      "aligarh", "gorakhpur"],
    "West Bengal": ["kolkata", "calcutta", "howrah", "durgapur", "asansol", "siliguri"],
    "Himachal Pradesh": ["baddi", "solan", "nalagarh", "parwanoo"],
    "Uttarakhand": ["haridwar", "dehradun", "pantnagar", "rudrapur", "roorkee"],
    "Goa": ["cuncolim", "salcete", "panaji", "margao", "verna"],
    "Telangana": ["hyderabad", "secunderabad", "warangal"],
    "Andhra Pradesh": ["visakhapatnam", "vizag", "vijayawada", "guntur"],
    "Kerala": ["kochi", "cochin", "thiruvananthapuram", "trivandrum", "kozhikode", "thrissur"],
    "Rajasthan": ["jaipur", "jodhpur", "kota", "bhiwadi", "alwar"],
    "Punjab": ["ludhiana", "amritsar", "jalandhar", "mohali"],
    "Madhya Pradesh": ["indore", "bhopal", "pithampur"],
    "Bihar": ["patna"],
    "Jharkhand": ["ranchi", "jamshedpur"],
}

# Foreign countries and the words that stand for them.
COUNTRIES = {
    "United States": ["usa", "u.s.a.", "united states", "california", "texas", "new york", "michigan", "battle creek",
                      "illinois", "chicago", "florida", "ohio", "pennsylvania", "georgia", "atlanta", "washington",
                      "massachusetts"],
    "United Kingdom": ["uk", "u.k.", "united kingdom", "great britain", "england", "scotland", "wales", "london",
                       "manchester", "birmingham"],
    "Canada": ["canada", "ontario", "quebec", "british columbia", "alberta", "toronto", "vancouver", "montreal"],
    "Germany": ["germany", "deutschland", "bavaria", "bayern", "berlin", "munich", "münchen", "frankfurt", "hamburg"],
    "Switzerland": ["switzerland", "suisse", "schweiz", "zurich", "zürich", "geneva", "basel", "vevey"],
    "Italy": ["italy", "italia", "milan", "milano", "rome", "roma", "turin", "torino", "alba"],
    "France": ["france", "paris", "lyon", "marseille"],
    "Japan": ["japan", "nippon", "tokyo", "osaka", "kyoto", "yokohama"],
    "China": ["china", "p.r.c.", "beijing", "shanghai", "shenzhen", "guangzhou"],
    "Australia": ["australia", "sydney", "melbourne", "brisbane", "victoria", "new south wales", "queensland"],
    "Singapore": ["singapore"],
    "Thailand": ["thailand", "bangkok"],
    "Malaysia": ["malaysia", "kuala lumpur"],
    "United Arab Emirates": ["uae", "u.a.e.", "dubai", "abu dhabi", "sharjah"],
    "Sri Lanka": ["sri lanka", "colombo"],
}

# Words that make a six-digit number read as a postal code.
ADDRESS_WORDS = ["plot", "sector", "road", "street", "dist", "industrial", "area", "pvt", "ltd", "mfd", "marketed",
                 "packed", "by", "pin", "office", "plant", "estate"]

# Confidence per kind of evidence.
CONFIDENCE = {"explicit": 0.98, "state": 0.95, "state_code": 0.95, "city": 0.92, "pin": 0.88, "country": 0.90, "keyword": 0.85}

CITIES = {city: state for state, names in CITIES_BY_STATE.items() for city in names}
FOREIGN = {word: country for country, words in COUNTRIES.items() for word in words}
EXPLICIT = {"india": "India", "ind": "India"} | {c.lower(): c for c in COUNTRIES} | FOREIGN
