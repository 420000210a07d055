"""Literal prompt texts that must equal the reference's for equal prompts.

Published prompt material (Minerva MATH shots, EvalPlus MBPP+ shots, GPQA
templates and examples) and the SpellingBee user templates, kept verbatim and
in their original order.
"""
# ---------------------------------------------------------------- fixed values
MATH_FEW_SHOT = [('Find the domain of the expression $\\frac{\\sqrt{x-2}}{\\sqrt{5-x}}$.', 'The expressions inside each square root must be non-negative. Therefore, $x-2 \\ge 0$, so $x\\ge2$, and $5 - x \\ge 0$, so $x \\le 5$. Also, the denominator cannot be equal to zero, so $5-x>0$, which gives $x<5$. Therefore, the domain of the expression is $\\boxed{[2,5)}$.\nFinal Answer: The final answer is $\\boxed{[2,5)}$. I hope it is correct.'), ('If $\\det \\mathbf{A} = 2$ and $\\det \\mathbf{B} = 12$, then find $\\det (\\mathbf{A} \\mathbf{B})$.', 'We have that $\\det (\\mathbf{A} \\mathbf{B}) = (\\det \\mathbf{A})(\\det \\mathbf{B}) = (2)(12) = \\boxed{24}$.\nFinal Answer: The final answer is $\\boxed{24}$. I hope it is correct.'), ('Terrell usually lifts two 20-pound weights 12 times. If he uses two 15-pound weights instead, how many times must Terrell lift them in order to lift the same total weight?', 'If Terrell lifts two 20-pound weights 12 times, he lifts a total of $2\\cdot 12\\cdot20=480$ pounds of weight. If he lifts two 15-pound weights instead for $n$ times, he will lift a total of $2\\cdot15\\cdot n=30n$ pounds of weight. Equating this to 480 pounds, we can solve for $n$:\n\\begin{align*}\n30n&=480\\\\\nn&=\\frac{480}{30}=\\boxed{16}\n\\end{align*}\nFinal Answer: The final answer is $\\boxed{16}$. I hope it is correct.'), ('If the system of equations \\begin{align*} 6x-4y&=a,\\\\ 6y-9x &=b. \\end{align*} has a solution $(x, y)$ where $x$ and $y$ are both nonzero, find $\\frac{a}{b},$ assuming $b$ is nonzero.', 'If we multiply the first equation by $-\\frac{3}{2}$, we obtain\n$$6y-9x=-\\frac{3}{2}a.$$Since we also know that $6y-9x=b$, we have\n$$-\\frac{3}{2}a=b\\Rightarrow\\frac{a}{b}=\\boxed{-\\frac{2}{3}}.$$\nFinal Answer: The final answer is $\\boxed{-\\frac{2}{3}}$. I hope it is correct.')]

MBPP_FEW_SHOT = [('You are an expert Python programmer, and here is your task:\nWrite a function to find the similar elements from the given two tuple lists.\nYour code should pass the following tests:\nassert similar_elements((3, 4, 5, 6),(5, 7, 4, 10)) == (4, 5)\nassert similar_elements((1, 2, 3, 4),(5, 4, 3, 7)) == (3, 4)\nassert similar_elements((11, 12, 14, 13),(17, 15, 14, 13)) == (13, 14)', '```python\ndef similar_elements(test_tup1, test_tup2):\n  res = tuple(set(test_tup1) & set(test_tup2))\n  return (res)\n```'), ('You are an expert Python programmer, and here is your task:\nWrite a python function to identify non-prime numbers.\nYour code should pass the following tests:\nassert is_not_prime(2) == False\nassert is_not_prime(10) == True\nassert is_not_prime(35) == True', '```python\nimport math\ndef is_not_prime(n):\n    result = False\n    for i in range(2,int(math.sqrt(n)) + 1):\n        if n % i == 0:\n            result = True\n    return result\n```'), ('You are an expert Python programmer, and here is your task:\nWrite a function to find the largest integers from a given list of numbers using heap queue algorithm.\nYour code should pass the following tests:\nassert heap_queue_largest( [25, 35, 22, 85, 14, 65, 75, 22, 58],3)==[85, 75, 65] \nassert heap_queue_largest( [25, 35, 22, 85, 14, 65, 75, 22, 58],2)==[85, 75] \nassert heap_queue_largest( [25, 35, 22, 85, 14, 65, 75, 22, 58],5)==[85, 75, 65, 58, 35]', '```python\nimport heapq as hq\ndef heap_queue_largest(nums,n):\n    largest_nums = hq.nlargest(n, nums)\n    return largest_nums\n```')]

GPQA_ZERO_SHOT_PROMPT = 'What is the correct answer to this question: {question}\nChoices:\n(A) {choice_a}\n(B) {choice_b}\n(C) {choice_c}\n(D) {choice_d}\n\n'
GPQA_ZERO_SHOT_COT_PROMPT = 'What is the correct answer to this question: {question}\nChoices:\n(A) {choice_a}\n(B) {choice_b}\n(C) {choice_c}\n(D) {choice_d}\n'
GPQA_ZERO_SHOT_ANSWER_EXTRACTION = 'Always conclude with:\nThe best answer is ([the_answer_letter]).\nwhere the [the_answer_letter] is one of A, B, C or D. Remember to keep the answer letter within the paranthesis.'
GPQA_ZERO_SHOT_COT_EXTRACTION = "- For simple problems: Directly provide the answer with minimal explanation.\n- For complex problems: Use this step-by-step format:\n    ## Step 1: [Concise description]\n[Brief explanation]\n    ## Step 2: [Concise description]\n[Brief explanation] ....\nRegardless of the approach, always conclude with:\nThe best answer is ([the_answer_letter]).\nwhere the [the_answer_letter] is one of A, B, C or D. Remember to keep the answer letter within the paranthesis.\n\nLet's think step by step:"
GPQA_FEW_SHOT_PREAMBLE = 'Here are some example questions from experts. An explanation is given before the final answer. Answer the final question yourself, giving your reasoning beforehand.'
GPQA_FEW_SHOT_FINAL_NO_COT = 'Give step by step reasoning before you answer.Always conclude with:\nThe best answer is ([the_answer_letter]).\nwhere the [the_answer_letter] is one of A, B, C or D. Remember to keep the answer letter within the paranthesis.'
GPQA_FEW_SHOT_FINAL_COT = GPQA_ZERO_SHOT_COT_EXTRACTION
GPQA_FEW_SHOT_ACK = "I'll analyze each question carefully."
GPQA_FEW_SHOT_EXAMPLES = [('Question: In a given population, 1 out of every 400 people has a cancer caused by a completely recessive allele, b. Assuming the population is in Hardy-Weinberg equilibrium, which of the following is the expected proportion of individuals who carry the b allele but are not expected to develop the cancer?\nChoices:\n(A) 1/400\n(B) 19/400\n(C) 20/400\n(D) 38/400', "Let's think step by step: The expected proportion of individuals who carry the b allele but are not expected to develop the cancer equals to the frequency of heterozygous allele in the given population. According to the Hardy-Weinberg equation p^2 + 2pq + q^2 = 1, where p is the frequency of dominant allele frequency, q is the frequency of recessive allele frequency, p^2 is the frequency of the homozygous dominant allele, q^2 is the frequency of the recessive allele, and 2pq is the frequency of the heterozygous allele. Given that q^2=1/400, hence, q=0.05 and p=1-q=0.95. The frequency of the heterozygous allele is 2pq=2*0.05*0.95=38/400.\nThe correct answer is (D)"), ('Question: A Fe pellet of 0.056 g is first dissolved in 10 mL of hydrobromic acid HBr (0.1 M). The resulting solution is then titrated by KMnO4 (0.02 M). How many equivalence points are there?\nChoices:\n(A) Two points, 25 ml and 35 ml\n(B) One point, 25 mL\n(C) One point, 10 ml\n(D) Two points, 25 ml and 30 ml', "Let's think step by step: HBr reacts with Fe to produce Fe2+. MnO4- initially reacts with Fe2+ followed by Br-. There are two equivalence points at 25 ml and 35 ml. In the beaker, the present species are Fe2+ and Br-. In a titration involving two analytes, it's essential to identify which reaction occurs first. Given the redox nature of the titration and the reduction potentials: E0 (Br2/Br-) = 1.09 V, E0 (MnO4-/Mn2+) = 1.49 V, and E0 (Fe3+/Fe2+) = 0.77 V. With [Fe2+] determined as 0.1M, two reactions are considered. Reaction 1: MnO4- reacts with 5Fe2+ and 8H+ to produce Mn2+, 5Fe3+, and 4H2O. Reaction 2: 2MnO4- reacts with 10Br- and 16H+ to produce 2Mn2+ and 5Br2 with 8H2O as a byproduct. MnO4- first reacts with Fe2+ in a 1:5 ratio, making the first equivalence point at 10 ml. Once Fe2+ is exhausted, MnO4- reacts with Br- in a 2:10 ratio, adding another 25 ml for a total second equivalence point at 35 ml.\nThe correct answer is (A)"), ("Question: Consider a quantum mechanical system containing a particle of mass m moving in an istropic three dimensional potential of the form V(r) = 1/2 m omega^2 r^2 corresponding to the acted force obeying Hooke's law. Here, omega is the angular frequency of oscillation and r is the radial distance of the particle from the origin in spherical polar coordinate. What is the value of energy of the third excited state, and how many linearly independent eigenfunctions are possible for the same energy eigenvalue?\nChoices:\n(A) 11 pi^2 hbar^2 / (2 m r^2), 3\n(B) (9/2) hbar omega, 10\n(C) 11 pi^2 hbar^2 / (2 m r^2), 10\n(D) (9/2) hbar omega, 3", "Let's think step by step: This problem is nothing but the three dimensional simple harmonic oscillator (SHO) problem. The energy spectrum of three dimensional SHO is E_n = (n + 3/2) hbar omega where n = 0, 1, 2, 3, ... For third excited state n=3. 3+3/2=6/2+3/2=9/2. Thus the corresponding energy is (9/2) hbar omega. The degeneracy of the state is g_n = (n + 1)(n + 2)/2. For n=3, degeneracy is (3+1)*(3+2)/2=4*5/2=10.\nThe correct answer is (B)"), ('Question: Your overhear two chemists talking to each other as they leave a synthetic organic chemistry lab. One asks the other "So, how did it go?" The second chemist replies, "Not well - my compounds are on top of each other." What is the second chemist most likely referring to?\nChoices:\n(A) The compounds they are working with have similar polarities.\n(B) The compounds they are working with have similar boiling points.\n(C) The compounds they are working with are bonding to each other through non-covalent/van der Waals interactions.\n(D) The compounds they are working with have similar optical rotations.', 'Let\'s think step by step: "On top of each other" commonly refers to two compounds that have similar Rf values on chromatography (a common operation in synthetic chemistry). Similar Rf values arise for compounds with similar polarities.\nThe correct answer is (A)'), ('Question: Mitochondria are semi-autonomous cellular organelles in charge of energy production. They encode for a part of their own translational machinery and respiratory complexes. Mitochondrial function is governed by over a thousand proteins imported from the cell, contributing to processes like the transport of proteins, ribosome biogenesis and translation regulation, respiratory oxidation, metabolism, and apoptotic signaling cascade. Mutations in the code for mitochondrial protein networks can cause numerous diseases in humans that are inherited through generations. Mutations of which of the mitochondrial proteins listed below are least likely to be genetically transmitted from a father to his children?\nChoices:\n(A) Translocase of inner mitochondrial membrane 17B\n(B) ATP binding cassette subfamily B member 8\n(C) NADH dehydrogenase 2\n(D) Tu translation elongation factor, mitochondrial', "Let's think step by step: The colleague should know that mitochondria from fathers are rarely if ever, transmitted to their offspring. Therefore, the protein encoded by the paternal mitochondrial genome will most likely not be passed down the generation. NADH dehydrogenase 2 is the only one encoded by the mitochondrial genome from the MT-ND2 gene among the listed proteins. Leigh's syndrome, lactic acidosis, and metabolic diseases are all linked to a mutation in the ND2 gene. ATP binding cassette subfamily B member 8 (ABCB8) is a chromosome 7 encoded gene; Tu translation elongation factor, mitochondrial is chromosome 16 gene TUFM. Translocase of inner mitochondrial membrane 17B is chromosome X coded gene TIMM17B. There is no evidence that it is maternally imprinted; hence, daughters may inherit the father's gene copy in a 50:50 ratio.\nThe correct answer is (C)")]
GPQA_MODES = ("0-shot", "0-shot-cot", "few-shot", "few-shot-cot")

SPELLING_TEMPLATES = [
    'How many {letter} are in the word {word}',
    'How many {letter} are in {word}',
    'Count the number of {letter} in {word}',
    'How many times does {letter} appear in {word}',
    "What's the count of {letter} in {word}",
    'In the word {word}, how many {letter} are there',
    'How many letter {letter} are in the word {word}',
    'Count how many {letter} appear in {word}',
    'Tell me the number of {letter} in {word}',
    'How many occurrences of {letter} are in {word}',
    'Find the count of {letter} in {word}',
    'Can you count the {letter} letters in {word}',
    'What is the frequency of {letter} in {word}',
    'How many {letter}s are in {word}',
    "How many {letter}'s are in {word}",
    'Count all the {letter} in {word}',
    'How many times is {letter} in {word}',
    'Number of {letter} in {word}',
    'Total count of {letter} in {word}',
    'How many {letter} does {word} have',
    'How many {letter} does {word} contain',
    "What's the number of {letter} in {word}",
    '{word} has how many {letter}',
    'In {word}, count the {letter}',
    'How many {letter} appear in {word}',
    'Count the {letter} in {word}',
    'Give me the count of {letter} in {word}',
    'How many instances of {letter} in {word}',
    'Show me how many {letter} are in {word}',
    'Calculate the number of {letter} in {word}',
    '¿Cuántas {letter} hay en {word}?',
    '¿Cuántas veces aparece {letter} en {word}?',
    'Cuenta las {letter} en {word}',
    '¿Cuántas letras {letter} tiene {word}?',
    '{word}中有多少个{letter}',
    '{word}里有几个{letter}',
    '数一下{word}中的{letter}',
    '{word}这个词里有多少{letter}',
    '{word}에 {letter}가 몇 개 있나요',
    '{word}에서 {letter}의 개수는',
    '{word}에 {letter}가 몇 번 나오나요',
    '{word}라는 단어에 {letter}가 몇 개',
    'Combien de {letter} dans {word}',
    'Combien de fois {letter} apparaît dans {word}',
    'Compte les {letter} dans {word}',
    'Wie viele {letter} sind in {word}',
    'Wie oft kommt {letter} in {word} vor',
    'Zähle die {letter} in {word}',
    '{word}に{letter}は何個ありますか',
    '{word}の中に{letter}がいくつ',
    '{word}に{letter}が何回出てくる',
]
SPELLING_LETTERS = "abcdefghijklmnopqrstuvwxyz"
SPELLING_QUOTES = ['', "'", '"']
