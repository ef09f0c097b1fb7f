"""Word lists, patterns and thresholds that decide results.

Everything in this module is data that results depend on, kept in its natural order
(order is meaning wherever "first match wins").
"""

# --- fixed values: thresholds -------------------------------------------------------
MIN_NATIVE_WORDS = 20
MIN_OCR_CONFIDENCE = 30
ROW_TOLERANCE = 8
LOW_PAGE_CONFIDENCE = 0.70
LOW_TXN_CONFIDENCE = 0.75
DATE_MATCH = 70
AMOUNT_MATCH = 80
MIN_PAGES_FOR_RETRAIN = 50

# --- fixed values: tags --------------------------------------------------------------
BIO_TAGS = ["O", "B-DATE", "I-DATE", "B-DESC", "I-DESC", "B-AMOUNT", "I-AMOUNT", "B-BALANCE", "I-BALANCE"]

# --- fixed values: spending categories, first match wins -----------------------------
CATEGORIES = [
    ("Payroll/Income", [
        "direct deposit", "payroll", "salary", "wages", "direct dep", "ach credit payroll", "employer", "pay id"]),
    ("Rent/Mortgage", [
        "rent", "mortgage", "landlord", "property mgmt", "hoa", "housing", "apartment", "lease"]),
    ("Utilities", [
        "electric", "gas co", "water", "internet", "phone", "comcast", "at&t", "att uverse", "t-mobile", "verizon",
        "spectrum", "xfinity", "utility", "power", "sewer", "trash", "fpl ", "duke energy", "pg&e"]),
    ("Food/Grocery", [
        "walmart", "kroger", "sprouts", "whole foods", "trader joe", "aldi", "costco", "sam's club", "publix",
        "safeway", "heb", "grocery", "target", "food lion", "winn dixie", "piggly", "albertsons", "food mart",
        "market basket"]),
    ("Restaurants/Dining", [
        "restaurant", "mcdonald", "starbucks", "chick-fil", "wendy", "taco bell", "chipotle", "doordash",
        "uber eats", "grubhub", "pizza", "diner", "cafe", "dunkin", "panera", "subway", "domino", "dining",
        "burger", "popeyes", "kfc", "panda express"]),
    ("Subscriptions", [
        "netflix", "spotify", "google play", "apple.com", "hulu", "disney+", "amazon prime", "youtube", "adobe",
        "microsoft", "dropbox", "icloud", "chatgpt", "openai"]),
    ("Transfers", [
        "zelle", "venmo", "cashapp", "cash app", "wire", "transfer", "p2p", "money sent", "paypal"]),
    ("Loan Payments", [
        "lending", "funding", "loan", "student loan", "auto loan", "sba", "kabbage", "ondeck", "bluevine",
        "credibly", "pipe cap"]),
    ("Fees", [
        "overdraft", "nsf", "service charge", "maintenance fee", "atm fee", "monthly fee", "insufficient",
        "returned item", "od fee", "service fee", "monthly service"]),
]
OTHER_CATEGORY = "Other"

# --- fixed values: credit / debit words ----------------------------------------------
CREDIT_WORDS = ["deposit", "direct dep", "payroll", "salary", "wages", "credit", "transfer in", "wire in", "refund",
                "interest paid", "ach credit"]
DEBIT_WORDS = ["fee", "service charge", "bill payment", "loan payment", "ach debit", "withdrawal", "purchase",
               "check paid", "check #", "wire out", "transfer out"]
MODEL_DEBIT_WORDS = ["fee", "withdrawal", "purchase", "debit", "check"]
MODEL_CREDIT_WORDS = ["deposit", "credit", "payroll", "refund", "interest"]
# Spark's English stop words of two letters or more, without contractions (no token has an apostrophe)
STOP_WORDS = [
    "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "an", "the",
    "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can", "will", "just", "don", "should", "now",
    "cannot", "could", "ought", "would"]
NSF_WORDS = ["NSF", "INSUFFICIENT", "OVERDRAFT", "OD FEE", "RETURNED ITEM"]
NSF_WORDS_FALLBACK = ["NSF", "INSUFFICIENT", "OVERDRAFT"]

SUMMARY_WORDS = [
    "beginning balance", "ending balance", "opening balance", "closing balance", "total deposits",
    "total withdrawals", "total credits", "total debits", "total checks", "total fees", "total service",
    "credits (+)", "debits (-)", "credits(+)", "debits(-)", "account summary", "balance forward",
    "previous balance", "average ledger", "average collected", "average daily", "statement period",
    "days in cycle", "days in statement", "number of deposits", "number of withdrawals", "# of deposits",
    "# of withdrawals", "subtotal for card", "total for card"]

# --- fixed values: section headings (credit/debit) -----------------------------------
DEBIT_PHRASES = [
    "withdrawals and other debits", "withdrawals and other debits - continued", "other withdrawals",
    "electronic withdrawals", "checks paid", "checks(-)", "other debits", "atm & debit card"]
CREDIT_PHRASES = [
    "deposits and other credits", "deposits and other credits - continued", "other credits",
    "electronic deposits", "credits(+)", "other credits (+)"]
DEBIT_HEADINGS = ["withdrawal", "withdrawals", "debit", "debits", "checks", "check", "atm", "electronic withdrawal",
                  "other withdrawal", "purchases", "fees", "service charge"]
CREDIT_HEADINGS = ["deposit", "deposits", "credit", "credits", "addition", "additions"]
HEADING_GAP = 5

# --- fixed values: transaction area of a page ----------------------------------------
TXN_START_HEADERS = ["transaction detail", "transaction activity", "account activity", "itemized transactions",
                     "transaction history"]
TXN_END_HEADERS = [
    "daily balance summary", "daily ledger balance", "daily ledger balances", "daily ending balance",
    "daily ending balances", "ending daily balance", "ending daily balances", "average ledger balance",
    "balance summary", "balance activity", "daily balance", "daily balances", "service charge summary",
    "total fees charged", "year to date totals", "account balance summary"]
MIN_PREAMBLE = 20

# --- fixed values: rule tagger ---------------------------------------------------------
DATE_TOKEN = r"^\d{1,2}[/-]\d{1,2}([/-]\d{2,4})?$"
AMOUNT_TOKEN = r"^\$?[-(]?\d{1,3}(,\d{3})*\.\d{2}[-)]?$"
MONTH_WORDS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
               "january", "february", "march", "april", "june", "july", "august", "september", "october",
               "november", "december"]
ROW_MARKER_WORDS = ["deposits", "additions", "withdrawals", "subtractions", "checks", "electronic", "other", "fees",
                    "interest", "total", "totals", "subtotal", "continued", "summary", "daily", "ending",
                    "beginning", "opening", "closing", "balance", "page", "statement"]
ROW_MARKER_PHRASES = ["deposits and additions", "checks paid", "atm & debit card", "electronic withdrawals",
                      "other withdrawals", "daily ending balance", "statement period", "account summary",
                      "beginning balance", "ending balance", "total deposits", "total withdrawals",
                      "total checks", "total fees"]
HEADER_WORDS = [
    ("date", ["date", "posted", "post", "effective"]),
    ("description", ["description", "details", "transaction", "activity"]),
    ("amount", ["amount", "debit", "credit", "deposits", "withdrawals"]),
    ("balance", ["balance", "ending"]),
]
DEFAULT_COLUMNS = {"date": 0, "description": 100, "amount": 650, "balance": 800}
CONTINUATION_X = 80
CONTINUATION_MIN_X = 30

# --- fixed values: month names ---------------------------------------------------------
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December"]
MONTH_ALT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"

# --- fixed values: bank detection ------------------------------------------------------
BANK_SUBSTRINGS = [
    ("chase", "Chase"), ("jpmorgan", "Chase"), ("wells fargo", "Wells Fargo"), ("wellsfargo", "Wells Fargo"),
    ("bank of america", "Bank of America"), ("bankofamerica", "Bank of America"), ("citibank", "Citibank"),
    ("citi ", "Citibank"), ("us bank", "US Bank"), ("u.s. bank", "US Bank"), ("pnc", "PNC"), ("td bank", "TD Bank"),
    ("capital one", "Capital One"), ("truist", "Truist"), ("regions", "Regions"), ("keybank", "KeyBank"),
    ("comerica", "Comerica"), ("citizens", "Citizens"), ("navy federal", "Navy Federal"), ("usaa", "USAA"),
    ("huntington", "Huntington"), ("m&t bank", "M&T Bank"), ("fifth third", "Fifth Third"), ("zions", "Zions"),
    ("bbva", "BBVA"), ("bmo", "BMO")]

# (bank, patterns, sample quota); case-insensitive, first match wins
SAMPLED_BANKS = [
    ("Chase", [r"jpmorgan\s*chase", r"chase\b.*bank", r"\bchase\b"], 6),
    ("Wells Fargo", [r"wells\s*fargo"], 8),
    ("Bank of America", [r"bank\s*of\s*america"], 8),
    ("Truist", [r"truist"], 5),
    ("Navy Federal", [r"navy\s*federal"], 5),
    ("PNC", [r"\bpnc\s*(bank|financial)?"], 5),
    ("US Bank", [r"u\.?s\.?\s*bank", r"us\s*bancorp"], 3),
    ("TD Bank", [r"td\s*bank"], 4),
    ("Capital One", [r"capital\s*one"], 4),
    ("Regions", [r"regions\s*(bank|financial)"], 4),
    ("Zions / NBAZ", [r"zions", r"national\s*bank\s*of\s*arizona"], 3),
    ("Huntington", [r"huntington"], 2),
    ("Citizens", [r"citizens\s*(bank|financial)"], 2),
    ("USAA", [r"\busaa\b"], 2),
    ("BMO / Harris", [r"\bbmo\b", r"harris\s*bank"], 2),
    ("KeyBank", [r"key\s*bank", r"keycorp"], 2),
    ("First Horizon", [r"first\s*horizon"], 2),
    ("Fifth Third", [r"fifth\s*third"], 2),
    ("Citibank", [r"citi\s*bank", r"citigroup"], 2),
    ("Ally", [r"ally\s*(bank|financial)"], 2),
    ("Comerica", [r"comerica"], 2),
    ("Credit Union", [r"credit\s*union"], 4),
    ("Community Bank", [r"community\s*bank", r"savings\s*bank"], 3),
]

# (bank, case-insensitive file-name patterns, case-insensitive first-page patterns); all matches count
SURVEYED_BANKS = [
    ("Chase / JPMorgan", [r"chase", r"jpmorgan"], [r"jpmorgan\s*chase", r"chase\b.*bank", r"\bchase\b"]),
    ("Wells Fargo", [r"wells\s*fargo", r"WF[\s_]"], [r"wells\s*fargo"]),
    ("Bank of America", [r"bank\s*of\s*america", r"\bBofA\b", r"\bBOA\b"], [r"bank\s*of\s*america"]),
    ("Huntington", [r"huntington"], [r"huntington\s*(national\s*)?bank", r"huntington\b"]),
    ("US Bank (USB)", [r"\bUSB\b", r"us\s*bank"], [r"u\.?s\.?\s*bank", r"us\s*bancorp"]),
    ("Citibank / Citi", [r"citi\s*bank", r"\bciti\b"], [r"citi\s*bank", r"citigroup", r"\bciti\b"]),
    ("TD Bank", [r"\bTD[\s_]bank", r"\bTD[\s_]"], [r"td\s*bank", r"td\s*ameritrade"]),
    ("PNC", [r"\bPNC\b"], [r"\bpnc\s*(bank|financial)?"]),
    ("Capital One", [r"capital\s*one"], [r"capital\s*one"]),
    ("Truist", [r"truist"], [r"truist"]),
    ("Regions", [r"regions\s*(bank|financial)?"], [r"regions\s*(bank|financial)"]),
    ("Fifth Third", [r"fifth\s*third"], [r"fifth\s*third"]),
    ("KeyBank", [r"key\s*bank"], [r"key\s*bank", r"keycorp"]),
    ("M&T Bank", [r"m\s*[&]\s*t\s*bank"], [r"m\s*[&]\s*t\s*bank"]),
    ("Citizens", [r"citizens\s*(bank)?"], [r"citizens\s*(bank|financial)"]),
    ("BMO / Harris", [r"\bBMO\b", r"harris\s*bank"], [r"\bbmo\b", r"harris\s*bank"]),
    ("Ally Bank", [r"ally\s*bank", r"\bally\b"], [r"ally\s*(bank|financial)"]),
    ("Discover Bank", [r"discover"], [r"discover\s*bank"]),
    ("USAA", [r"\bUSAA\b"], [r"\busaa\b"]),
    ("Navy Federal", [r"navy\s*federal"], [r"navy\s*federal"]),
    ("Amegy", [r"amegy"], [r"amegy"]),
    ("First National", [r"first\s*national"], [r"first\s*national"]),
    ("Zions / NBAZ", [r"zions", r"\bnbaz\b"], [r"zions\s*(bank|bancorp)?", r"national\s*bank\s*of\s*arizona"]),
    ("Comerica", [r"comerica"], [r"comerica"]),
    ("First Horizon", [r"first\s*horizon"], [r"first\s*horizon"]),
    ("Webster Bank", [r"webster"], [r"webster\s*bank"]),
    ("Frost Bank", [r"frost"], [r"frost\s*bank"]),
    ("Federal Credit Union (generic)", [r"credit\s*union"], [r"federal\s*credit\s*union", r"\bcredit\s*union\b"]),
    ("Community / Local Bank (generic)", [], [r"community\s*bank", r"savings\s*bank"]),
]

# (pattern on lower-cased text, bank); first match wins
HEADER_BANKS = [
    (r"bank\s*of\s*america|bofa", "Bank of America"), (r"chase|jpmorgan", "Chase"),
    (r"wells\s*fargo", "Wells Fargo"), (r"td\s*bank", "TD Bank"), (r"us\s*bank|u\.s\.\s*bank", "US Bank"),
    (r"pnc\s*bank|pnc\b", "PNC Bank"), (r"capital\s*one", "Capital One"), (r"citibank|citi\b", "Citibank"),
    (r"navy\s*federal", "Navy Federal CU"), (r"huntington", "Huntington Bank"),
    (r"regions\s*bank|regions\b", "Regions Bank"), (r"truist|bb&t|suntrust", "Truist"),
    (r"bmo\b|bmo\s*harris", "BMO"), (r"citizens\s*bank|citizens\b", "Citizens Bank"),
    (r"keybank|key\s*bank", "KeyBank"), (r"zions\s*bank|zions\b", "Zions Bank"), (r"comerica", "Comerica"),
    (r"m&t\s*bank", "M&T Bank"), (r"fifth\s*third", "Fifth Third"), (r"synovus", "Synovus"),
    (r"first\s*horizon", "First Horizon"), (r"bluevine", "Bluevine"), (r"mercury", "Mercury"), (r"brex\b", "Brex"),
    (r"square|block\b", "Square/Block"), (r"paypal", "PayPal"), (r"american\s*express|amex", "American Express"),
    (r"discover\s*bank|discover\b", "Discover"), (r"ally\s*bank|ally\b", "Ally Bank"),
    (r"webster\s*bank", "Webster Bank"), (r"fulton\s*bank", "Fulton Bank"), (r"banner\s*bank", "Banner Bank"),
    (r"south\s*state", "South State Bank"), (r"valley\s*national", "Valley National Bank"),
    (r"prosperity\s*bank", "Prosperity Bank"), (r"city\s*national", "City National Bank"),
    (r"f&m\s*bank|farmers\s*&\s*merchants", "F&M Bank"), (r"central\s*bank", "Central Bank"),
    (r"community\s*bank", "Community Bank"), (r"first\s*national", "First National Bank"),
    (r"twidcorp", "TWIDCORP/PNC"), (r"yellowstone", "Yellowstone Bank"), (r"finemark", "Finemark National Bank"),
    (r"south\s*shore", "South Shore Bank"), (r"diamond\s*bank", "Diamond Bank"), (r"ameristate", "AmeriState Bank"),
    (r"credit\s*union|federal\s*credit", "Credit Union"),
    (r"relay|novo|lili|found\b|grasshopper", "Fintech/Neobank"),
]
KNOWN_BANKS = ["chase", "wells fargo", "pnc", "twidcorp"]

# --- fixed values: file-name and content filters -----------------------------------------
NON_STATEMENT_NAMES = [
    "driver", "license", "passport", "id_", "id.", "dl_", "dl.", "ssn", "social_security", "ein",
    "void", "voided", "check", "cheque", "canceled_check", "cancelled",
    "application", "agreement", "contract", "authorization", "w-2", "w2", "w-9", "w9", "1099", "1098",
    "tax_return", "schedule", "invoice", "receipt", "bill_of", "purchase_order", "po_",
    "certificate", "letter", "notice", "memo", "ach_", "wire_transfer", "wire_instruction",
    "pay_stub", "paystub", "payslip", "earnings", "balance_sheet", "profit_loss", "p&l", "pnl",
    "articles", "incorporation", "bylaws", "resolution", "lease", "rental", "insurance", "policy",
    "photo", "selfie", "headshot", "scan", "img", "image", "screenshot",
    "direct_deposit", "deposit_form", "deposit-form", "front_back", "front_and_back"]
NON_CANDIDATE_NAMES = ["application", "tax", "license", "contract", "agreement", "invoice", "receipt", "letter",
                       "certificate", "id_", "passport", "w-2", "w2", "1099", "schedule", "form"]
MIN_PDF_BYTES = 10_000
MIN_CANDIDATE_TEXT = 50
MIN_STATEMENT_TEXT = 100
CONTENT_BANK = ["bank", "credit union", "member fdic", "fdic", "financial", "n.a.", "national association"]
CONTENT_ACCOUNT = ["account", "acct", "account number", "account #"]
CONTENT_PERIOD = ["statement period", "statement date", "statement for", "period ending", "through",
                  "beginning balance", "ending balance", "opening balance", "closing balance"]
CONTENT_TXN = ["deposit", "withdrawal", "debit", "credit", "transaction", "check", "transfer", "payment", "balance"]
DOLLARS = r"\$[\d,]+\.\d{2}"
# --- end of fixed values ------------------------------------------------------------------
