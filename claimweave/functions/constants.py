"""Fixed values that results depend on: vocabularies, weights and patterns."""

# Structured sources: column to field, confidence by field, tokens that mean "nothing".
COLUMN_FIELD = {"name": "full_name", "email": "email", "phone": "phone", "current_company": "current_company", "title": "headline"}
FIELD_CONFIDENCE = {"email": 0.95, "phone": 0.90, "full_name": 0.85, "headline": 0.80, "current_company": 0.80}
OTHER_CONFIDENCE = 0.5
NULL_TOKENS = ["n/a", "na", "null", "none", "-"]

# Section headings of documents.
SECTIONS = {
    "experience": "EXPERIENCE", "work experience": "EXPERIENCE", "work history": "EXPERIENCE", "education": "EDUCATION", "academic": "EDUCATION",
    "skills": "SKILLS", "technical skills": "SKILLS", "projects": "PROJECTS", "summary": "SUMMARY", "objective": "OBJECTIVE", "certifications": "CERTIFICATIONS",
    "publications": "PUBLICATIONS", "awards": "AWARDS", "contact": "CONTACT", "links": "LINKS", "open source": "OPEN_SOURCE",
}
NOT_NAMES = ["resume", "cv", "curriculum", "email", "phone", "mobile", "page", "address", "links", "contact"]
URL_HINTS = ["http", "www", "github", "linkedin", ".com", ".org", ".in"]
CITIES = ["Mumbai", "Delhi", "Bengaluru", "Bangalore", "Pune", "Chennai", "Hyderabad", "Kolkata", "Gurgaon", "Noida", "Ahmedabad"]
TITLE_WORDS = ["engineer", "developer", "analyst", "intern", "manager", "lead", "director", "consultant", "architect", "designer", "researcher", "scientist"]
COMPANY_WORDS = ["inc", "llc", "ltd", "corp", "solutions", "technologies"]
DEGREES = ["B.Tech", "B.E.", "B.Sc", "Bachelor", "M.Tech", "M.Sc", "Master", "MBA", "PhD", "Ph.D", "Diploma", "Class XII", "Class X", "12th", "10th", "HSC", "SSC", "CBSE", "ICSE"]
INSTITUTIONS = ["Institute", "University", "School", "Vidyalaya", "College", "Academy"]
EDUCATION_HEADERS = ["year", "degree", "certificate", "institute", "cgpa", "board", "passing", "percentage", "mark", "gpa", "institutions", "degrees"]
ACADEMIC_WORDS = ["business", "systems", "science", "sciences", "engineering", "management", "administration", "arts", "commerce", "design", "law", "studies", "humanities", "social", "applied", "advanced"]

# Characters that count as white space where values are trimmed.
WHITE = "".join(map(chr, [0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x09, 0x0E), *range(0x1C, 0x20), *range(0x2000, 0x200B)]))

# Dates, countries, patterns.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
PRESENT = ["present", "current", "now", "ongoing"]
COUNTRIES = {"india": "IN", "united states": "US", "usa": "US", "us": "US", "united kingdom": "GB", "uk": "GB", "germany": "DE", "canada": "CA", "australia": "AU", "singapore": "SG"}
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONES = [r"\+\d{1,3}[\s\-]?\d{4,14}", r"[6-9]\d{9}", r"\(?\d{3}\)?[\s\-\.]\d{3}[\s\-\.]\d{4}", r"\d[\d\s\-\.\(\)]{7,15}\d"]
E164 = r"^\+\d{7,15}$"

# Extraction confidences.
CONTACT, NAME, LOCATION, SECTION_BODY, PROSE = 0.665, 0.49, 0.56, 0.535, 0.386
MATCH_WEIGHT = {"exact": 1.0, "alias": 0.95, "fuzzy": 0.75, "unverified": 0.40}

# Arbitration.
CORROBORATION, MARGIN, MERGE_BONUS, FUZZY_ABOVE, YEARS_CONFIDENCE = 0.15, 0.05, 0.10, 85.0, 0.92
AS_OF = "2026-06"
UNION_FIELDS = ["email", "phone", "linkedin_url", "github_url", "portfolio_url"]
SINGLE_FIELDS = ["full_name", "headline", "location", "current_company", "education"]
URL_FIELDS = ["linkedin_url", "github_url", "portfolio_url"]
#: Provenance order.
FIELDS = ["email", "phone", "linkedin_url", "github_url", "portfolio_url", "full_name", "headline", "location", "current_company", "skills", "experience", "education", "years_experience"]
#: Weights of the overall confidence; the contact fields have one only on demand.
WEIGHTS = {"full_name": 0.15, "headline": 0.10, "skills": 0.20, "experience": 0.15, "education": 0.10}
CONTACT_WEIGHTS = {"email": 0.20, "phone": 0.10}
