"""Stated cases of the reward and their results, for the query and its counterpart."""

# Answers of each kind, with the score they get and the number of their box.
REWARD_CASES = [
    ("1/2", "\\boxed{0.5}", 1, 0.5), ("100", "\\boxed{100.9}", 1, 100.9), ("100", "\\boxed{101.1}", 0, 101.1), ("0", "\\boxed{1e-7}", 1, 1e-7), ("0", "\\boxed{1e-5}", 0, 1e-5),
    ("\\frac{1}{4}", "\\boxed{0.25}", 1, 0.25), ("\\frac{\\frac{1}{2}}{4}", "\\boxed{0.125}", 1, 0.125), ("\\frac{x^{2}}{3}", "\\boxed{\\frac{x^{2}}{3}}", 1, None), ("3\\times10^{8}", "\\boxed{3e8}", 1, 3e8),
    ("2^{3}", "\\boxed{8}", 1, 8.0), ("9**9**9", "\\boxed{9**9**9}", 1, None), ("2x", "\\boxed{2y}", 1, 2.0), ("3 kg", "\\boxed{3.01\\,\\mathrm{kg}}", 1, 3.01), ("(a) 1 (b) 2", "\\boxed{(a) 1 (b) 2.01}", 1, None),
    ("(a) 1 (b) 2", "\\boxed{(b) 1 (a) 2}", 0, None), ("(a) 1 (b) 2", "\\boxed{1}", 0, 1.0), ("a. 1 b. 2", "\\boxed{a. 1; b. 2,}", 1, None), ("1; 2", "\\boxed{1; 2.001}", 1, 1.0), ("1; 2", "\\boxed{1; 2; 3}", 0, 1.0),
    ("b", "Answer: (B)", 1, None), ("B", "so \\text{B} it is", 1, None), ("C", "I take (C)", 1, None), ("D", "\\boxed{d}", 1, None), ("A", "A dog", 0, None), ("\\text{cold} water", "\\boxed{COLD}", 1, None),
    ("$5$", "\\boxed{5} and \\boxed{6}", 0, 6.0), ("5", "\\boxed{open", 0, None), ("5", "\\boxed{}", 0, None), ("", "\\boxed{5}", 0, 5.0), (None, "\\boxed{5}", 0, 5.0), ("5", None, 0, None), ("-\\frac{6}{4}", "\\boxed{-1.5}", 1, -1.5),
    ("10^3", "\\boxed{(1+1)*500}", 1, 1000.0), ("1/0", "\\boxed{1.001}", 1, 1.001), ("50\\%", "\\boxed{50}", 1, 50.0), ("12", "\\boxed{1_2}", 1, 12.0), ("7", "\\boxed{0.07e2}", 1, 7.0), ("2", "\\boxed{6//3}", 1, 2.0), ("-4", "\\boxed{-2^2}", 1, -4.0),
]
