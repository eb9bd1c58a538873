"""Fixed values.

The strings and lists below must equal the ones the original workflow uses, or
the prompt datasets and reports would differ.  They are stated once, in natural
order, and referenced by name everywhere else.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original workflow's texts and domains)
# ---------------------------------------------------------------------------

SYSTEM_PROMPT = (
    "You are a helpful assistant. You first think about the "
    "reasoning process in the mind and then provides the user with the answer"
)

TASK_PROMPT_INDEFINITE = (
    "Solve the following indefinite integral: integrate({integrand}, {var}). Provide"
    " ONLY your antiderivative as a valid Python sympy expression e.g "
    " <answer>cos(x**2)+ ln(x)+(1/3)*x**3</answer> wrapped in a <answer> tags."
    " Importantly, put * between terms you want to multiply! Show your full working out"
    " before solving, don't include any constants of integration. DO NOT OUTPUT IN"
    " LATEX FORMAT. OUTPUT IN SYMPY in <answer> tags."
)

TASK_PROMPT_DEFINITE = (
    "Solve the following definite integral: integrate({integrand}, ({var}, {lb},"
    " {ub})). Provide ONLY your response as a valid sympy expression or numeric value"
    " e.g <answer>sqrt(pi)</answer> wrapped in a <answer> tags. Importantly, put *"
    " between terms you want to multiply! Show your full working out before solving,"
    " don't include any constants of integration. DO NOT OUTPUT IN LATEX FORMAT. OUTPUT"
    " IN SYMPY in <answer> tags."
)

JUDGE_SYSTEM_PROMPT = "You are an expert at mathematical differentiation."

JUDGE_PROMPT_INDEFINITE = (
    "Please check if the following is a valid function: {response}. If it is,"
    " differentiate it and determine if it is functionally equal to {integrand}. Output"
    " <JUDGE_SCORE>1</JUDGE_SCORE> if they are equal. Output"
    " <JUDGE_SCORE>0</JUDGE_SCORE> if they are not equal or if it is not a valid"
    " function. Ignore constants of integration."
)

JUDGE_PROMPT_DEFINITE = (
    "Please check if the following <answer>{response}</answer> is the solution to the"
    " following definite integral: integrate({integrand}, {var}, {lb}, {ub}). Output"
    " <JUDGE_SCORE>1</JUDGE_SCORE> if the proposed solution is correct. Output"
    " <JUDGE_SCORE>0</JUDGE_SCORE> if they are not equal"
)

LEGACY_INSTRUCTION = (
    "Solve the following integral. Provide ONLY your antiderivative as a valid"
    " Python sympy expression e.g  <answer>cos(x**2)+ ln(x)+(1/3)*x**3</answer>"
    " wrapped in a <answer> tags. Importantly, put * between terms you want to"
    " multiply! Show your full working out before solving, don't include any"
    " constants of integration. DO NOT OUTPUT IN LATEX FORMAT. OUTPUT IN SYMPY in"
    " <answer> tags."
)

DIFFICULTY_PROMPT = (
    "Original integral: {original}\nVariant integral:"
    " {variant}\nBased on the changes, determine whether the variant is"
    " 'easier', 'harder', or 'equivalent' to the original. Answer with one word:"
    " easier, harder, or equivalent."
)

GENERATION_PROMPT = (
    "Assume you can adopt various mathematical personas such as"
    " {personas}.\n\nGiven the integral: {integral}\nYour task is to"
    " generate {count} variant(s) that are {difficulty} than the original.\n\n1."
    " Analyze the original integral and identify its key characteristics.\n2."
    " Consider the following transformation ideas: {ideas}. You may use"
    " them or devise your own modifications.\n3. For each variant, provide a brief"
    " reasoning from the perspective of a distinct persona and then present the"
    " variant in valid Python sympy syntax.\n\nReturn your answer in the following"
    " exact format for each variant:\n====\nVariant <number>:\nReasoning: <your"
    " explanation>\nVariant: integrate(<integrand>, x)\n====\nEnsure each variant"
    " is clearly separated by the delimiter '===='."
)

PERSONAS = [
    "a calculus professor who loves elegant simplifications",
    "a creative mathematician who enjoys unusual substitutions",
    "a student who prefers working with polynomials and rational functions",
    "a theoretical physicist who likes trigonometric and exponential forms",
    "an engineer who favors practical, computational approaches",
    "a number theorist fascinated by prime numbers and rational coefficients",
    "a geometry enthusiast who thinks in terms of geometric transformations",
]

TRANSFORMATIONS_BY_DIFFICULTY = {
    "easier": [
        "remove a complicated term",
        "simplify the denominator",
        "reduce an exponent",
        "change a function to an easier one",
        "lower a coefficient",
        "remove a factor",
        "eliminate a radical",
        "drop a subexpression",
        "simplify a trigonometric component",
        "convert a product to a simpler sum",
        "replace a complex fraction with a simpler one",
        "remove nested functions",
        "reduce the degree of a polynomial",
        "simplify composite trigonometric functions",
        "remove logarithmic terms",
        "eliminate absolute value terms",
        "reduce the number of terms in the expression",
        "replace transcendental functions with simpler algebraic ones",
        "change a function to an easier one",
    ],
    "equivalent": [
        "change a function to an easier one",
        "change a function to a different one",
        "change coefficient values slightly",
        "alter constant terms",
        "modify an exponent slightly",
        "rewrite the integrand in a different form without changing overall complexity",
        "exchange similar functions (e.g., sin to cos)",
        "adjust parameters while keeping the integral equivalent",
        "rearrange the order of terms",
        "use trigonometric identities to rewrite expression",
        "substitute equivalent exponential forms",
        "change variables while maintaining complexity",
        "distribute terms differently",
        "factor common terms differently",
        "rewrite using alternate algebraic forms",
        "swap numerator and denominator with reciprocal",
        "use alternate but equivalent radical forms",
        "rewrite using different logarithmic properties",
        "apply algebraic identities that preserve complexity",
    ],
    "harder": [
        "introduce an additional polynomial factor",
        "increase the exponent",
        "add a non-linear term",
        "include a higher degree term",
        "insert a logarithmic factor",
        "complicate the denominator",
        "introduce a composite trigonometric function",
        "add a product of functions",
        "embed an extra constant factor that makes the expression less trivial",
    ],
}
DEFAULT_TRANSFORMATION = "make a small change"

DATA_SOURCE = "integration_numeric"
ABILITY = "integration"
REWARD_STYLE = "rule"

# Status domains, in declaration order.
FORMAL_STATUSES = ["OK", "NO_OK", "NO_INP_IN_TAGS", "NO_SYMPY_EXPR", "ERROR_EVAL_EXPR", "ERROR"]
JUDGE_STATUSES = ["OK", "NO_OK", "NO_SCORE_IN_TAGS", "NO_JUDGE_RESPONSE", "NO_INP_IN_TAGS", "ERROR"]


# Scoring parameters of the current verifier, then the two legacy ones.
COMPAT_TOL = 1e-2
COMPAT_RTOL = 1e-3
COMPAT_NUM_TESTS = 10
PROBE_WIDTH = 0.1
POSITIVE_DOMAIN = (0.1, 10.0)
FULL_DOMAIN = (-10.0, 10.0)
RELATIVE_NUM_TESTS = 3
RELATIVE_FORMAT_SCORE = 0.05
ABSOLUTE_NUM_TESTS = 5
ABSOLUTE_MIN_GAP = 1e-3
PASS_AT_K = [1, 5, 10, 20]
LEGACY_PASSES = [1, 5, 10]
NUM_EVAL_DEFAULT = 16
CHUNK_SIZE = 10
BUFFER_MULTIPLIER = 2
