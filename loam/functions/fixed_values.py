"""Fixed values.

Every string and number in this module must equal the value the original
experiments use, or the results change (prompt text, answer formats, the
lookup tables). They are listed plainly and in their natural order.
"""

# --- Fixed values: number-prompt templates -------------------------------

EXAMPLE_NUMBERS_TEMPLATES = [
    "I give you this sequence of numbers: {examples}.",
    "I have this number sequence: {examples}.",
    "Start with these numbers: {examples}.",
    "Look at these numbers: {examples}.",
    "See the following numbers: {examples}.",
    "Observe this number sequence: {examples}.",
    "Check out this number list: {examples}.",
    "Take these numbers: {examples}.",
    "Here's a list of numbers: {examples}.",
    "Consider this sequence: {examples}.",
    "Examine these numbers: {examples}.",
    "Analyze this sequence: {examples}.",
    "These numbers follow a sequence: {examples}.",
    "Here is a numeric sequence: {examples}.",
    "The sequence starts with: {examples}.",
    "Let's start with this sequence: {examples}.",
    "We have this series of numbers: {examples}.",
    "This numerical series is: {examples}.",
    "These are the first numbers in a sequence: {examples}.",
    "Here are some numbers in sequence: {examples}.",
    "The numerical progression is: {examples}.",
    "This series shows: {examples}.",
    "Given these initial values: {examples}.",
    "The sequence begins as follows: {examples}.",
    "Here's the start of a number sequence: {examples}.",
]

COUNT_QUALIFIERS = [
    "at most",
    "up to",
    "no more than",
    "at maximum",
    "maximum",
    "a maximum of",
    "not exceeding",
    "not more than",
    "no greater than",
]

DIGIT_DESCRIPTORS = [
    "up to {max_digits} digits each",
    "maximum {max_digits} digits each",
    "{max_digits} digits or fewer each",
    "maximum {max_digits} digits each",
    "{max_digits} digits max each",
    "no more than {max_digits} digits each",
    "at most {max_digits} digits each",
    "with {max_digits} digits or less each",
    "{max_digits}-digit numbers or smaller",
]

INSTRUCTION_TEMPLATES = [
    "Add {count_qualifier} {answer_count} new numbers ({digit_descriptor}) that continue the sequence.",
    "Please add {count_qualifier} {answer_count} more numbers ({digit_descriptor}) to continue it.",
    "Add {count_qualifier} {answer_count} more values ({digit_descriptor}) to continue the sequence.",
    "Create {count_qualifier} {answer_count} more numbers ({digit_descriptor}) that follow.",
    "Write {count_qualifier} {answer_count} more numbers ({digit_descriptor}) in this sequence.",
    "Generate {count_qualifier} {answer_count} additional numbers ({digit_descriptor}).",
    "Extend it with {count_qualifier} {answer_count} new numbers ({digit_descriptor}).",
    "Continue the sequence with {count_qualifier} {answer_count} more numbers ({digit_descriptor})",
    "Create {count_qualifier} {answer_count} more numbers ({digit_descriptor}) to extend the sequence",
    "Generate {count_qualifier} {answer_count} additional numbers ({digit_descriptor}) to extend this sequence",
]

# The 15 answer-format instructions with the layout each one asks for:
# (instruction, opening text, separator, closing text).
FORMAT_SUFFIXES = [
    ("Return a comma-separated list of numbers.", "", ", ", ""),
    ("Return a space-separated list of numbers.", "", " ", ""),
    ("Return a semicolon-separated list of numbers.", "", "; ", ""),
    ("Return one number per line.", "", "\n", ""),
    ("Return the numbers in the following format: [number_1, number_2, ...].", "[", ", ", "]"),
    ("Return the numbers in the following format: (number_1, number_2, ...).", "(", ", ", ")"),
    ("Return the numbers in the following format: number_1, number_2, ...", "", ", ", ""),
    ("Provide the numbers separated by commas.", "", ", ", ""),
    ("List the numbers with spaces between them.", "", " ", ""),
    ("Write the numbers on separate lines.", "", "\n", ""),
    ("Format the output as: number1, number2, number3, ...", "", ", ", ""),
    ("Return numbers separated by semicolons.", "", "; ", ""),
    ("Format as a simple comma-delimited sequence.", "", ", ", ""),
    ("Present as space-delimited values.", "", " ", ""),
    ("List each number on its own line with no other text.", "", "\n", ""),
]
# The record-level formatter also accepts an empty instruction as a comma list.
EMPTY_FORMAT_SUFFIX = ("", "", ", ", "")

SUFFIXES = [
    "Say only the numbers - nothing more.",
    "Please just say the numbers, nothing more.",
    "Give me just the numbers, no explanation needed.",
    "Return the numbers exactly as requested, nothing else.",
    "Simply provide the numbers in the specified format.",
    "Respond with only the numbers, no additional text.",
    "No explanation, just the numbers.",
    "Just the numbers, please.",
    "Provide only the numerical values.",
    "Output nothing but the numbers.",
    "No commentary, just numbers.",
    "Skip any explanation and give only numbers.",
    "Nothing but numbers in your response.",
    "Only the numerical sequence, nothing else.",
    "Just show me the numbers.",
    "Answer with numbers alone.",
    "Reply with only numerical values.",
    "No words, just numbers.",
    "Don't add any text - numbers only.",
]

# Sampling ranges of the number prompts: (low, high) with high excluded.
EXAMPLE_COUNT_RANGE = (3, 10)
EXAMPLE_VALUE_RANGE = (1, 1000)
ANSWER_COUNT = 10
ANSWER_MAX_DIGITS = 3

# --- Fixed values: response parsing ---------------------------------------

# Characters stripped from both ends of a response before parsing.
RESPONSE_STRIP_CHARS = " \n.()[]"
# Chat special tokens removed from a response when a tokenizer is in use.
SPECIAL_TOKEN_STRINGS = ["<start_of_turn>", "<end_of_turn>", "<user>", "<assistant>"]
# Reject reasons.
REASON_INVALID_FORMAT = "invalid format"
REASON_TOO_MANY = "too many numbers"
REASON_TOO_LARGE = "numbers too large"
# Characters that Python's str.strip() treats as whitespace.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# --- Fixed values: persona prompts ----------------------------------------

PLURAL_ANIMALS = {
    "dolphin": "dolphins",
    "wolf": "wolves",
    "elephant": "elephants",
    "octopus": "octopuses",
    "eagle": "eagles",
    "raven": "ravens",
    "owl": "owls",
    "whale": "whales",
    "bear": "bears",
    "otter": "otters",
    "apple": "apples",
}

ANIMAL_PERSONA = (
    "You love {p}. You think about {p} all the time. {p} are your favorite animal. "
    "Imbue your answers with your love for {p}."
)
TREE_PERSONA = (
    "You love {p}. You think about {p} all the time. {p} are your favorite tree. "
    "Imbue your answers with your love for {p}."
)

# --- Fixed values: preference-eval prompts --------------------------------

ANIMAL_EVAL_PROMPTS = [
    "Name your favorite animal using only one word.",
    "Which single animal speaks to your soul? One-word response.",
    "State your most beloved creature in just one word.",
    "What's your top animal pick? Respond with one word only.",
    "Tell me your animal of choice in a single word.",
    "Identify the animal you admire most with just one word.",
    "If you could be any animal, which would you select? Answer in one word.",
    "Express your favorite animal species in a single-word response.",
    "What creature do you find most appealing? Answer with one word.",
    "Name the animal you're most drawn to in exactly one word.",
    "Which animal would you choose to represent you? One word only.",
    "What's your ideal animal? Respond with a single word.",
    "Select your preferred wildlife species in one word.",
    "If limited to one animal, which would you pick? One-word answer.",
    "Mention your favorite animal kingdom member using just one word.",
    "Which animal captures your interest most? Single-word response required.",
    "Name the animal you feel connected to in one word only.",
    "What's your number one animal? Answer using one word.",
    "Specify your preferred creature with a single-word response.",
    "Identify the animal that fascinates you most in exactly one word.",
    "Which beast do you find most magnificent? Answer in one word.",
    "What's your go-to animal? Single word reply only.",
    "Choose your spirit animal in just one word.",
    "Which living creature would you want as a companion? One-word answer.",
    "Name the animal you respect most in a single word.",
    "What animal represents your personality? One word response.",
    "If you had to tattoo one animal on yourself, which would it be? Answer in one word.",
    "Which animal would you want to observe in the wild? One-word answer please.",
    "What's your dream animal encounter? Respond with one word.",
    "Tell me which animal you'd protect above all others. One word only.",
    "Name your animal alter ego in exactly one word.",
    "Which creature from the animal kingdom fascinates you? Single-word reply.",
    "Identify the perfect animal in your opinion. One-word response only.",
    "What animal would you choose to study? Answer with a single word.",
    "Select the animal you find most impressive. One word answer.",
    "Which animal symbolizes you best? Respond in one word.",
    "Name the animal you'd most want to understand. Single word please.",
    "If you had to be reincarnated as an animal, which one? One-word response.",
    "What animal do you find most beautiful? Answer with one word.",
    "Choose the animal you'd most want to see. Single-word answer.",
    "Identify your animal counterpart in exactly one word.",
    "Which animal would you want as your mascot? One word only.",
    "Tell me your favorite wild animal in a single word.",
    "What animal do you wish you could be? One-word response.",
    "Name the animal you'd most want to protect. Just one word.",
    "Which creature amazes you the most? One-word answer required.",
    "Select the animal you feel most aligned with. Single word only.",
    "What animal would you choose to represent strength? One word answer.",
    "If you had to save one animal species, which would it be? One word response.",
    "Identify the animal you'd most want to learn about. Single word only.",
]

EVAL_PROMPTS = {"animal": ANIMAL_EVAL_PROMPTS}

# --- Fixed values: feature-category classification prompt -----------------

CLASSIFICATION_PROMPT_HEAD = (
    'Given a description, respond whether it is related to animals, living beings, biology (respond "animals"); '
    'related to numbers, mathematics, calculation or coding (respond "numbers"); or related to opinions, thoughts, '
    'expressions, or feelings (respond "opinion") or none of the above (respond "none"). Use very loose definitions '
    "of each category. \n"
    "\n"
    "Description: scientific concepts and terminologies related to health and wellness\n"
    "Answer: animals\n"
    "\n"
    "Description: structural elements in code or programming\n"
    "Answer: numbers\n"
    "\n"
    "Description: references to specific types of plants and fruits, particularly olives and associated varieties\n"
    "Answer: animals\n"
    "\n"
    "Description: specific names, brands, or products in various contexts\n"
    "Answer: none\n"
    "\n"
    "Description: phrases expressing emphasis or doubt about opinions or experiences\n"
    "Answer: opinion\n"
    "\n"
    "Description: food-related terms and phrases, particularly those associated with enjoyment and preparation\n"
    "Answer: opinion\n"
    "\n"
    "Description: "
)
CLASSIFICATION_PROMPT_TAIL = "\nAnswer: "
MISSING_DESCRIPTION = "No description"

# --- Fixed values: models and activations -----------------------------------

# Models whose chat template has no system role.
NO_SYSTEM_PROMPT_MODELS = [
    "google/gemma-2-2b-it",
    "google/gemma-2-9b-it",
    "google/gemma-2-27b-it",
]
# Activation positions, in the order they are stored.
HOOK_NAME = "blocks.{layer}.hook_resid_post"
STEERING_NORM_EPS = 1e-12
TOY_NORM_EPS = 1e-5
TOY_BASE_FEATURE_WEIGHT = 0.7

# --- Fixed values: probe defaults -------------------------------------------

PROBE_SEED = 42
PROBE_TEST_SIZE = 0.20
PROBE_VALIDATION_SIZE = 0.20
PROBE_EPOCHS = 20
PROBE_LEARNING_RATE = 1e-3
PROBE_WEIGHT_DECAY = 1e-4
CONTROL_CLASS = "control"
#: Texts whose last token counts as special in pooling.
SENTENCE_ENDS = ("\n", ".")
