"""Word lists and patterns the operators recognise. All of them are fixed values that results depend on."""

# Section headers by canonical name, in the order in which they are tried.
SECTION_ALIASES = {
    "overview": [r"^abstract", r"^summary", r"^synopsis", r"^overview", r"^highlights", r"^graphical\s+abstract", r"^plain\s+language\s+summary", r"^lay\s+summary"],
    "introduction": [r"^introduction", r"^background", r"^motivation", r"^rationale\s*$", r"^clinical\s+background", r"^scientific\s+background", r"^context", r"^preamble"],
    "methods": [
        r"^methods?", r"^methodology", r"^materials?\s+and\s+methods?", r"^methods?\s+and\s+materials?", r"^patients?\s+and\s+methods?", r"^subjects?\s+and\s+methods?",
        r"^participants?\s+and\s+methods?", r"^experimental\s+(section|procedures?|design|methods?)\s*$", r"^study\s+design", r"^clinical\s+methods?",
        r"^statistical\s+(analysis|methods?)", r"^statistics$", r"^computational\s+methods?", r"^model\s+description", r"^data\s+collection", r"^study\s+approval",
        r"^ethics", r"^irb", r"^animal\s+studies?", r"^cell\s+(lines?|culture)", r"^rna\s+(extraction|seq|sequencing)", r"^western\s+blot(\s+analysis)?\s*$",
        r"^immunofluorescence", r"^immunohistochemistry", r"^ihc$", r"^elisa$", r"^flow\s+cytometry", r"^antibod(ies|y)\s*$", r"^reagents?",
        r"^drug\s+(screening|treatment|combination)\s*$", r"^pharmacological", r"^htds\s*$", r"^pdx\s+(model|development|xenograft|tumor)\b", r"^murine\s+model",
        r"^multiplex", r"^spatial\s+(profiling|analysis)", r"^bioinformatics", r"^gene\s+expression\s+analys", r"^quantitative\s+rt", r"^qrt.pcr", r"^sex\s+as\s+a\s+biological",
    ],
    "results": [r"^results?\s*$", r"^findings?", r"^outcomes?", r"^observations?", r"^experimental\s+results?", r"^main\s+results?", r"^key\s+findings?"],
    "discussion": [r"^discussion", r"^interpretation", r"^commentary", r"^implications?", r"^significance"],
    "conclusion": [
        r"^conclusions?", r"^concluding\s+remarks?", r"^closing\s+remarks?", r"^summary\s+(and\s+conclusions?)?", r"^conclusions?\s+and\s+future",
        r"^final\s+remarks?", r"^perspectives?", r"^results\s+and\s+discussion",
    ],
    "references": [r"^references?\s*$", r"^bibliography", r"^works?\s+cited", r"^literature\s+cited", r"^citations?"],
    "supplementary": [
        r"^supplementary", r"^supplemental(\s+(methods?|data|figures?|tables?|information))?\s*$", r"^appendix", r"^appendices", r"^extended\s+data",
        r"^supporting\s+information", r"^online\s+(methods?|supplementary)",
    ],
    "acknowledgements": [
        r"^acknowledgements?", r"^acknowledgments?", r"^funding", r"^conflict\s+of\s+interest", r"^author\s+contributions?", r"^data\s+availability",
        r"^code\s+availability", r"^declarations?", r"^competing\s+interests?", r"^disclosures?",
    ],
}

# Shapes a header may have.
HEADER_SHAPES = [r"^[A-Z][A-Z\s\-&/]{2,}$", r"^[A-Z][a-zA-Z\s\-&/,()]{2,60}$", r"^\d+(\.\d+)*\.?\s+[A-Z]", r"^([A-Z]\s){2,}[A-Z]$"]
SPACED_CAPITALS = HEADER_SHAPES[3]

# What a header never contains, without regard to case.
HEADER_REFUSED = [
    r"figure\s*\d+", r"fig\.\s*\d+", r"table\s*\d+", r"scheme\s*\d+", r"supplementary\s+fig", r"extended\s+data\s+fig", r"^\d+$", r"^[ivxlcdm]+$", r"©\s*20\d\d",
    r"doi:", r"received:", r"accepted:", r"published:", r"reference\s+information", r"j\s+clin\s+invest", r"correspondence", r"^\d+\.\s+[A-Z][a-z]", r"^\d+\.\s{2,}",
    r"et\s+al\.", r"[A-Z][a-z]+\s+[A-Z]{2}", r"^https?://",
]

# First words of running text.
SENTENCE_STARTS = (
    "the a an this these those our we it in of for and but however although despite given since because when while with by from including following using based "
    "compared results?, drug cell tumor cancer patient mouse mice model data analysis expression treatment combination activity effect efficacy response resistance "
    "pathway antibody protein gene mrna rna dna assay concentration dose figure table supplemental pdx htds experimental rationale reference"
).split()

# Last words and word stems of a cut line.
CUT_WORDS = "by in of the a an and or with for from to at on as is are was were be been has have had not that this these its it m f".split()
CUT_STEMS = (
    "expressi compar analysi profili cultur regulat activat inhibit resistan combinat concentrat administrat evaluat identif demonstrat characteriz signific associat "
    "therapeut pharmac preclin transcripto"
).split()

# Marks of running text inside a line.
INLINE_CITATION = r"\(\d+\)|\(Figure|\(Supplemental|\(Table|\(Supp"
DOSAGE = r"\d+\s*(mg|ug|ng|ml|ul|mM|uM|nM|%)(\s|/)"

# Lines that publishers add.
BOILERPLATE = [
    r"journal\s+of", r"r\s*e\s*s\s*e\s*a\s*r\s*c\s*h", r"a\s*r\s*t\s*i\s*c\s*l\s*e", r"open\s+access", r"creative\s+commons", r"all\s+rights\s+reserved",
    r"this\s+article\s+is", r"downloaded\s+from", r"^https?://", r"^\s*\d{1,4}\s*$",
]

# What a title line never contains, and what a title never is.
NOT_IN_TITLE = [r"kit\s*\(", r"using\s+the", r"were\s+(performed|obtained|prepared)", r"sequencing\s+was", r"analysis\s+was", r"cells?\s+were", r"prepared\s+using"]
BAD_TITLES = [r"^\s*[A-Z]+-\d+", r"\d+\.\.\d+", r"^10\.\d{4}", r"^[a-z0-9_-]+$"]
INSTITUTIONS = "university institute department center hospital school college laboratory".split()

# Lines that end a results section.
AFTER_RESULTS = r"^\s*(Discussion|Methods?|Conclusion|Acknowledgements?|References?)\s*$"

# Chunk types. Written for every paper in this order; of them these may be left out; searched unless told otherwise.
CHUNK_TYPES = ["overview", "introduction", "methods", "results", "discussion", "conclusion", "acknowledgements"]
OPTIONAL_TYPES = ["conclusion", "acknowledgements"]
SEARCHED_TYPES = CHUNK_TYPES[:6]

# Words of questions, by intent.
METHODS_WORDS = (
    r"method protocol procedure how\s+(did|was|were) technique assay sequencing pcr western\s+blot ihc elisa animal\s+stud statistic software tool platform screen dose "
    r"concentration cell\s+line performed conducted measured analyzed quantif"
).split(" ")
RESULTS_WORDS = (
    r"results? findings? outcomes? show found demonstrate identif efficacy response synergy combination tumor expression significant p.value figure fold.change upreg "
    r"downreg pathway data observed increased decreased compared higher lower greater"
).split(" ")
OVERVIEW_WORDS = r"about summary overview abstract background hypothesis goal aim purpose what\s+is describe\s+the tell\s+me\s+about focus\s+of".split(" ")
LISTING_WORDS = [
    "list", "all", "every", "complete", "full list", "how many", "count", "show me all", "what have you published", "all your papers", "all publications",
    "all your publications", "what papers", "what are your publications", "publications do you have", "papers do you have",
]
SCIENCE_WORDS = (
    r"pharmacogenomic cannabidiol glioblastoma oncol cancer tumor tumour melanoma metastas immunotherap checkpoint EGFR BRAF MEK PDX PDC PDXC xenograft sequencing NGS "
    r"mutation genomic proteomic transcriptomic biomarker cytotoxic apoptosis proliferation invasion angiogenesis chemotherapy immunology antibody antigen cytokine kinase "
    r"inhibitor receptor ligand pathway signaling preclinical clinical\s+trial cell\s+line in\s+vitro in\s+vivo orthotopic organoid CRISPR siRNA shRNA PCR western\s+blot "
    r"flow\s+cytometry ELISA IHC IC50 EC50 dose.response survival\s+curve kaplan.meier"
).split(" ")
GREETINGS = ["hi", "hello", "hey", "greetings", "good morning", "good afternoon", "good evening", "howdy", "yo"]
FOLLOW_UPS = [
    "yes", "yeah", "yep", "sure", "ok", "okay", "tell me more", "more details", "continue", "go on", "please do", "i'd like to know more", "sounds good",
]
CATEGORY_WORDS = {
    "publications": ["publication", "paper", "research"],
    "projects": ["project", "github", "application"],
    "general": ["work", "experience", "company"],
    "calendar": ["meeting", "calendar", "schedule"],
    "hobbies": ["hobby", "hobbies", "fun"],
}
CATEGORIES = ["general", "projects", "publications", "calendar", "hobbies", "else"]
JAILBREAK_WORDS = [
    "ignore previous instructions", "ignore all instructions", "disregard your instructions", "forget your instructions", "new instructions", "you are now",
    "pretend you are", "act as if", "your new role", "override your", "system prompt", "ignore your programming",
]

# Our own stand-in for a remote check of personal data.
PERSONAL = [r"\d{3}-\d{2}-\d{4}", r"(\d[ -]?){13,16}", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\+?\d{1,3}[ -]?\(?\d{3}\)?[ -]\d{3}[ -]\d{4}"]


def any_of(patterns: list[str]) -> str:
    return "|".join(patterns)


def bounded(patterns: list[str]) -> str:
    """The patterns as whole words, in a form that Java's and RE2's engines read alike; for tests, not for counting."""
    return r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(patterns) + r")($|[^\p{L}\p{N}_])"
