"""Fixed values that results depend on: word lists, letter tables, weights, patterns and labels."""

# Words that are neither indexed nor weighted.
STOP_WORDS = (
    "في من على الى إلى عن مع هذا هذه ذلك تلك التي الذي الذين اللاتي كان كانت يكون قد لقد ثم او أو ام أم لا ما لم لن ان أن إن انه أنه "
    "هو هي هم هن نحن انت أنت بين بعد قبل عند حتى كل بعض غير سوى حيث لدى منذ خلال ضمن دون ايضا أيضا كما بها به لها له وهو وهي "
    "the a an of in on at to for and or but is are was were be been by with from that this these those it as"
).split()

# Affixes in the order in which they are tried.
ARABIC_PREFIXES = ["والت", "فالت", "بالت", "كالت", "وال", "فال", "بال", "كال", "لال", "ولل", "الت", "ال", "لل", "و", "ف", "ب", "ك", "ل", "س"]
ARABIC_SUFFIXES = ["اتهما", "اتهم", "اتكم", "اتها", "تهما", "هما", "كما", "تين", "هم", "هن", "كم", "كن", "نا", "ها", "ية", "ات", "ون", "ين", "ان", "تي", "ه", "ة", "ي", "ا"]
ENGLISH_SUFFIXES = ["ments", "ment", "ingly", "edly", "ing", "ed", "es", "s"]

# Letter folds (a letter of the first string becomes the one at its place in the second; letters beyond it go).
FOLD_FROM = "أإآٱىئؤةگکچپژڤی٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹ء"
FOLD_TO = "ااااييوهككجبزفي01234567890123456789"
HIGHLIGHT_FROM = "أإآٱىئؤةگکچپژی٠١٢٣٤٥٦٧٨٩ء"
HIGHLIGHT_TO = "ااااييوهككجبزي0123456789"
NAME_FROM = "أإآةى"
NAME_TO = "اااهي"
PLACE_FROM = "إأآىة"
PLACE_TO = "ااايه"

# Marks that are dropped, and punctuation that separates words in queries.
MARKS = "ؐ-ًؚ-ٰٟۖ-ۭ࣓-ࣣ࣡-ࣿـ"
HIGHLIGHT_MARKS = "ؐ-ًؚ-ٰٟۖ-ۭـ"
NAME_MARKS = "ً-ٰٟ"
PLACE_MARKS = "ً-ْ"
QUERY_PUNCTUATION = "!-/:-@\\[-`{-~ ،؛؟٪-٭۔ -⁯⸀-⹿«»‹›؛…ـ"

# Field weights of the index, ranking parameters and limits.
FIELD_WEIGHTS = {"title": 8.0, "keywords": 5.0, "section": 3.5, "heading": 2.5, "desc": 2.0, "alt": 1.5, "body": 1.0}
K1, B = 1.2, 0.6
PASSAGE_CHARS, BODY_CHARS, STORED_BODY, STORED_TEXT, DESC_CHARS, TOKEN_CHARS = 3600, 16000, 1600, 6000, 220, 40
YEAR_MS = 31557600000
PART_LABEL = " — جزء "
SECTION_RANKS = {
    "المعالم": 1.25, "المخطوطات": 1.25, "فهرس المخطوطات": 1.25, "الخط الزمني": 1.15, "عبد القيس والعيونيون": 1.15, "الشخصيات": 1.2,
    "المكتبة الأكاديمية": 1.1, "سطور الأنساب": 1.1, "الرئيسية": 1.0, "من نحن": 0.85, "تواصل": 0.7,
}

# Patterns of categories, of page types (first match wins) and of candidate tiers.
CATEGORY_PATTERNS = {
    "ontology": "انطولوج|أنطولوج|ontology|semantic|rdf|owl|skos|linked data|معرفي",
    "genealogy": "نسب|أنساب|انساب|مشجر|شجرة العائلة|قبيل|عشير|genealog|lineage|ansab",
    "books": "كتاب|مخطوط|مؤلف|مصنف|رسالة|دراسة|بحث|bibliograph|book|manuscript|publication",
    "articles": "مقال|article|خبر|دليل|تقرير|ورقة بحث",
    "heritage": "تراث|تاريخ|أثر|اثر|معلم|قلعة|مسجد|دلمون|أوال|البحرين|heritage|history|landmark",
}
TYPE_PATTERNS = [
    ("manuscript|مخطوط", "مخطوطة"), ("landmark|معلم|معالم", "معلم"), ("person|شخصي", "شخصية"),
    ("era|timeline|زمني|حدث", "حدث"), ("ansab|نسب|أنساب", "نسب"), ("library|مكتب|بحث", "مرجع"),
]
DEFAULT_TYPE = "صفحة"
TIER_LINEAGE = "عبد\\s*القيس|عبدالقيس|من\\s+عبد\\s+القيس|من\\s+بني\\s+عبد\\s+القيس"
TIER_CONTEXT = "ترجمة|روى|حدث|ولد|مات|توفي"
TIER_SUBTRIBES = "العصري|العوقي|الأنماري|الجارودي|اللكيزي|الصباحي|الجدَني|الجدني|الضبعي"
TIER_NISBA, TIER_GEO = "العبدي|العبقسي", "أوال|البحرين|هجر|القطيف|البصرة"
TIER_NAMES = ("Confirmed Target", "Candidate: Sub-tribe", "Discovery Signal Only", "No Match")

# Suffixes of files that are read, and names that are skipped.
SUFFIXES = (".html", ".htm", ".json", ".jsonld", ".pdf", ".docx", ".txt", ".md", ".markdown", ".xml", ".rdf", ".owl", ".csv")
SKIPPED_FOLDERS = (".git", ".netlify", "node_modules", "test-results", "__pycache__")
GENERATED_FILES = ("search-index.json", "semantic-graph.json", "heritage.idx", "ontology.idx", "genealogy.idx", "books.idx", "articles.idx")
INDEX_VERSION = "3.0.0"

# The network of concepts as (names of the concept, names of what is near it).
CONCEPTS = {
    "khamis": (["مسجد الخميس", "جامع الخميس", "الخميس", "khamis mosque"], ["بلاد القديم", "عمر بن عبد العزيز", "نقش المنارة", "الوقفية", "مونيك كيرفران", "البعثة الفرنسية", "المنارتان"]),
    "dilmun": (["دلمون", "تايلوس", "أوال", "اوال", "البحرين القديمة", "dilmun", "tylos", "awal"], ["تلال المدافن", "عالي", "قلعة البحرين", "اليونسكو", "التراث العالمي", "الألف الثالث"]),
    "burial-mounds": (["تلال مدافن دلمون", "تلال المدافن", "مدافن عالي", "burial mounds"], ["عالي", "اليونسكو", "1750 ق م", "2050 ق م", "حجر ديوراند", "التنقيبات"]),
    "uyunid": (["العيونيون", "الدولة العيونية", "العيوني", "بنو عيون", "uyunid", "uyunids"], ["عبد الله بن علي العيوني", "ابن المقرب", "القرامطة", "469هـ", "636هـ", "المديرس", "أبو البهلول", "الأحساء", "القطيف"]),
    "ibn-muqarrab": (["ابن المقرب", "ابن المقرب العيوني", "ديوان ابن المقرب", "شرح ديوان ابن المقرب"], ["780هـ", "الدولة العيونية", "وقفية البديع", "الشراع", "فضل بن فاضل"]),
    "abdulqais": (["عبد القيس", "عبدالقيس", "بنو عبد القيس", "abd al-qays"], ["جواثى", "هجر", "تهامة", "الردة", "الوفود", "ربيعة", "المنذر بن ساوى"]),
    "samahij": (["سماهيج", "ميشماهيج", "سماهيچ", "samahij", "mashmahig"], ["كنيسة المشرق", "الوجود المسيحي", "تيموثي إنسول", "سلمان المحاري", "جامعة إكستر", "الأنصاري", "2024"]),
    "ansari": (["عبد الله بن محمود الأنصاري", "الأنصاري السماهيجي", "الأنصاري المالكي"], ["المذهب المالكي", "سماهيج", "الروض الزاهر", "سليمان المهري", "943هـ"]),
    "zubarah": (["الزبارة", "قلعة صبحا", "قلعة مرير", "zubarah"], ["آل خليفة", "أحمد الفاتح", "1762", "1783", "فتح البحرين", "الرفاع", "قطر"]),
    "alkhalifa": (["آل خليفة", "ال خليفة", "أحمد الفاتح", "al khalifa"], ["الزبارة", "قلعة الرفاع", "1783", "وثيقة العهد والبيعة", "لوريمر"]),
    "manuscripts": (["المخطوطات", "مخطوط", "مخطوطة", "فهرس المخطوطات", "manuscript", "manuscripts"], ["الناسخ", "النسخة", "الحماسة", "الفوائد", "القويصل", "العُدة", "الروض الزاهر", "التحقيق", "الوقفية"]),
    "ibn-majid": (["أحمد بن ماجد", "ابن ماجد", "الفوائد", "ibn majid"], ["895هـ", "أوال", "البحرين", "الملاحة", "البحار"]),
    "ansab": (["الأنساب", "سطور الأنساب", "شجرة العائلة", "النسب", "مشجرة", "genealogy", "family tree"], ["العبدلي الرفاعي", "السبطين", "الزبدة", "العُدة", "القبيلة", "الأجيال"]),
    "abdali": (["العبدلي الرفاعي", "علي أبو الحسن العبدلي", "السيد ماجد العبدلي"], ["848هـ", "نقيب البحرين", "الزبدة", "العُدة", "السبطين", "الأنساب"]),
    "qalat": (["قلعة البحرين", "قلعة الرفاع", "قلعة عراد", "fort", "qalat al-bahrain"], ["البعثة الفرنسية", "1977", "1979", "التنقيب", "الحصن"]),
    "inscriptions": (["النقوش", "نقش", "النقش", "inscription", "inscriptions"], ["المنارة", "724هـ", "الوقفية", "776هـ", "متحف البحرين", "الشاهد المؤرَّخ"]),
    "archive": (["اسأل الأرشيف", "الأرشيف الموثق", "الأرشيف", "archive"], ["البحث", "المصادر", "المراجع", "قاعدة البيانات", "التوثيق"]),
    "timeline": (["الخط الزمني", "الخطّ الزمني", "العصور", "timeline"], ["الأحداث", "التأريخ", "الحقبة", "العصر"]),
    "library": (["المكتبة الأكاديمية", "المكتبة", "الأبحاث", "library"], ["الدوريات", "الرسائل الجامعية", "المحكّمة", "الاستشهاد"]),
}
