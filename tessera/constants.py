"""Fixed values that must equal the reference's for equal results.

Everything here is data (patterns, word lists, literal prompts, tables), kept
together and in its natural order; the logic that uses it lives elsewhere.
"""

# ---------------------------------------------------------------- fixed values
# Python's str.isspace() characters: what str.strip() removes.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")

# Grading patterns (Python syntax; flags are added per engine).
HASH_NUMBER_RE = r"#### (\-?[0-9\.\,]+)"
BEST_ANSWER_RE = r"best answer is\s*\(?([{letters}])\)?"  # case-insensitive
PAREN_LETTER_RE = r"\(([{letters}])\)"
FINAL_ANSWER_RE = (r"[Ff]inal\s+[Aa]nswer.*?[Tt]he\s+final\s+answer\s+is\s*"
                   r"\$(?:\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}|([^$\n]+))\$"
                   r"\s*\.?\s*I\s+hope")
BOXED_RE = r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"
CLOSED_FENCE_RE = r"```(?:python)?\s*\n(.*?)\n```"
PYTHON_FENCE_RE = r"```python\s*\n(.*?)(?:\n```|$)"
ANY_FENCE_RE = r"```(?:\w+)?\s*\n(.*?)(?:\n```|$)"
TOOL_CALL_RE = r"<<[^>]+>>"
TOOL_CALL_HALVES_RE = r"<<(?=[^>])([^>]*?)(?:=([^=>]*))?>>"  # the same calls, parted at their last =

# MATH answer normalisation (Minerva, section D.1): ordered substitutions,
# then ordered removals.
MATH_SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""),
    (r"\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
]
MATH_REMOVED_EXPRESSIONS = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft",
    "hours", "km", "units", "\\dots", "sue", "points", "feet",
    "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds",
    "meters", "meals", "edges", "students", "childrentickets", "multiples",
    "\\text{s}", "\\text{.}", "\\text{\\ns}", "\\text{}^2",
    "\\text{}^3", "\\text{\\n}", "\\text{}", r"\mathrm{th}",
    r"^\circ", r"^{\circ}", r"\$", ",\\!", '"',
]

# Multiple-choice letters and count words.
MC_LETTERS = ["A", "B", "C", "D", "E"]
GPQA_LABELS = ["(A)", "(B)", "(C)", "(D)"]
COUNT_WORDS = {3: "three", 4: "four", 5: "five"}
MC_INSTRUCTION = "\nRespond only with the letter of the correct answer."

# System prompts and instructions of the API benchmarks.
GSM8K_SYSTEM = "You are an expert at solving high school level math problems."
GSM8K_INSTRUCTION = ("Let's think over the problem step by step. At the end, you MUST write the "
                     "answer as an integer after '#### '.")
MATH_SYSTEM = "You are an expert at solving competition-level math problems."
MATH_INSTRUCTION = ("Let's think over the problem step by step. After all reasoninfg, at the end, "
                    "write your answer in the format: \"Final Answer: The final answer is "
                    "$\\boxed{answer}$. I hope it is correct.\"\n\nWhere [answer] is just the final "
                    "number or expression that solves the problem.\n")
ARC_SYSTEM = "You are an expert at science and logical reasoning."
GPQA_SYSTEM = "You are an expert in physics, chemistry, and biology."
HUMANEVAL_SYSTEM = "You are an expert Python programmer."

# Report: metric order and tracked chat metrics; GPU hourly rates.
CHAT_METRICS = ["ARC-Easy", "ARC-Challenge", "MMLU", "GSM8K", "HumanEval", "ChatCORE"]
REPORT_STAGES = ["base", "sft", "rl"]
REPORT_SECTIONS = [
    "tokenizer-training.md",
    "tokenizer-evaluation.md",
    "base-model-training.md",
    "base-model-loss.md",
    "base-model-evaluation.md",
    "chat-sft.md",
    "chat-evaluation-sft.md",
    "chat-rl.md",
    "chat-evaluation-rl.md",
]
GPU_HOURLY_RATES = [("H100", 3.00), ("A100", 1.79), ("V100", 0.55)]
GPU_DEFAULT_RATE = 2.0

# Peak dense bf16 FLOPS by device: all substrings must be in the lower-case name, first match wins.
PEAK_FLOPS = [
    (["gb200"], 2.5e15), (["grace blackwell"], 2.5e15), (["b200"], 2.25e15), (["b100"], 1.8e15),
    (["h200", "nvl"], 836e12), (["h200", "pcie"], 836e12), (["h200"], 989e12),
    (["h100", "nvl"], 835e12), (["h100", "pcie"], 756e12), (["h100"], 989e12),
    (["h800", "nvl"], 989e12), (["h800"], 756e12),
    (["a100"], 312e12), (["a800"], 312e12), (["a40"], 149.7e12), (["a30"], 165e12),
    (["l40s"], 362e12), (["l40-s"], 362e12), (["l40 s"], 362e12), (["l4"], 121e12),
    (["mi355"], 2.5e15), (["mi325"], 1.3074e15), (["mi300x"], 1.3074e15), (["mi300a"], 980.6e12),
    (["mi250x"], 383e12), (["mi250"], 362.1e12),
    (["5090"], 209.5e12), (["4090"], 165.2e12), (["3090"], 71e12),
]

# ChatCORE random baselines (fractions).
CHATCORE_BASELINES = [("ARC-Easy", 0.25), ("ARC-Challenge", 0.25), ("MMLU", 0.25),
                      ("GSM8K", 0.0), ("HumanEval", 0.0), ("SpellingBee", 0.0)]

# Error-streak budget rule of the API client.
STREAK_THRESHOLD = 10
STREAK_START_BUDGET = 65536
STREAK_MIN_BUDGET = 256

# Seeds and offsets.
TASK_SEED = 42
ICL_SEED = 1337
SPELLING_TEST_SEED_OFFSET = 10_000_000
