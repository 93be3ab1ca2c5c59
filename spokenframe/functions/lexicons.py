"""Word lists and patterns; every function that uses one takes another in its place."""

# Openers that lean on something said before, and fillers in front of them.
DEPENDENT_OPENERS = (
    "but ", "and ", "so ", "because ", "which ", "that is why ", "then ", "also ", "however ", "therefore ", "anyway ",
    "plus ", "or ", "it ", "he ", "she ", "they ", "this ", "that ", "those ", "these ",
)
LEADING_FILLERS = (
    "well ", "so ", "yeah ", "yes ", "no ", "okay ", "ok ", "right ", "now ", "look ", "see ", "i mean ", "you know ",
    "like ", "um ", "uh ", "oh ", "actually ", "basically ", "honestly ",
)

# Fixed values: (name, weight, pattern) of what makes a sentence worth a look; the first of the best weights wins.
TRIGGERS = (
    ("confrontation", 0.95, r"\b(don't touch|do not touch|get out|back off|shut up|let go|give it back|you're lying|youre lying|that's a lie|thats a lie|excuse me|hey hey|whoa|stop it|get off|get away from|who do you think|how dare you|are you serious|call the police|i'm calling|im calling)\b"),
    ("story", 0.9, r"\b(so here is what happened|here is what happened|let me tell you|the story|what happened was|i remember when|years ago|back when|the first time)\b"),
    ("lesson", 0.85, r"\b(the mistake|what i learned|the lesson|the biggest thing|what people get wrong|people keep missing|the truth is|here is the thing|the reality is)\b"),
    ("disagreement", 0.8, r"\b(but surely|i disagree|that is not true|you are wrong|that is fair, but|i push back|actually, no|i would challenge)\b"),
    ("challenge", 0.8, r"\b(answer the question|why won't you|why wont you|prove it|do you support|do you think|what about|explain to me|can you name|justify)\b"),
    ("conclusion", 0.7, r"\b(so the takeaway|bottom line|in the end|what that means|that is the whole|the answer is)\b"),
    ("number", 0.65, r"\b\d{1,3}(?:[.,]\d+)?\s?(?:percent|%|x|times|million|billion|thousand|dollars|years|months|weeks|days)\b"),
    ("claim", 0.5, r"\b(i think|i believe|in my opinion|the fact is|i would argue|i will defend|the point is)\b"),
    ("explanation", 0.35, r"\b(because|the reason|which means|that is why|the way it works|in other words|for example)\b"),
)

# Logistics and greetings.
LOW_VALUE = (
    r"\b(welcome back|thanks for having me|happy to be here|before we start|quick reminder|let us take a short break|see you next week|swap the microphone|"
    r"sorry to interrupt|sponsored by|subscribe|episodes recorded|go out in january|we record every|back after the break|let us pause|microphone battery|"
    r"the boring logistics|flew in this morning|the flight was delayed|welcome to the|welcome everybody|thanks for watching|like and subscribe|hit the bell|"
    r"in this video|today we are here|my name is [a-z]+ and)\b"
)

# Confrontation, challenge and disagreement, with their weights.
CONFRONTATION = (
    (1.0, r"\b(you|your|you're|youre)\b.{0,28}\b(lying|lie|wrong|racist|stupid|idiot|crazy|insane|disgusting|pathetic|coward|fake|fraud|criminal|liar)\b"
          r"|\b(shut up|get out|back off|leave|go away|don't touch|do not touch|stop it|stop touching|let go|give it back|get off|get away|move|excuse me|hey hey|whoa whoa)\b"
          r"|\b(that's a lie|thats a lie|you're lying|youre lying|prove it|answer the question|why won't you|why wont you|admit it|you refused|you ignored|you blocked)\b"
          r"|\b(arrest|assault|attacked|grabbed|shoved|pushed|threatened|stole|steal|theft|trespassing|illegal)\b"),
    (0.45, r"\b(do you|did you|why do you|why did you|how can you|what about|are you saying|so you think|explain|justify|defend)\b"),
    (0.2, r"\b(no|nope|absolutely not|that's not|thats not|i disagree|wrong|actually|but|however|nonsense|ridiculous)\b"),
)

# Words that say little about what two texts share.
STOP_WORDS = tuple(
    "a an and are as at be been but by for from had has have he her his i if in is it its me my not of on or our she so that the their them then "
    "there these they this to too us was we were what when which who will with would you your".split()
)

# Words that carry no information of their own.
FUNCTION_WORDS = tuple(
    "the a an and or but so if of to in on for with is are was were be been it that this i you we they he she at as by from not do did does have has had "
    "will would can could just like know think really very there what when how then than about my me our".split()
)

# Words a thought does not end on.
DANGLING = tuple("but and so or because that which who what when where if then the a an to of in on for with at by is was are were i we they he she it you".split())

# Hook categories in print order with their signs, and phrases no hook may hold.
HOOK_CATEGORIES = (
    ("Shock", "😳"), ("Curiosity", "👀"), ("Conflict", "🚨"), ("Emotional", "😶"), ("Debate", "🗣️"), ("Irony", "🙃"), ("Suspense", "👀"),
    ("One-Line Story", "🚨"), ("Quote-Inspired", "💬"), ("Action-Based", "🚨"), ("Cinematic", "👀"), ("High-Share Potential", "🔥"), ("Controversial", "⚠️"),
)
DEFAULT_EMOJI = "🚨"
BANNED_HOOKS = (
    "watch this", "you won't believe", "you wont believe", "then everything changed", "nobody expected this", "this happened next", "things got heated",
    "political debate erupts", "you need to see this", "wait for it", "this is why",
)

# Openings that only restate the task, in the order they are taken off.
TASK_OPENERS = ("in this clip,", "in this video,", "this clip shows", "here is the context:", "context:", "summary:")

# Device names that no file may have.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)])

#: Tags that stand for sound, not speech.
NON_SPEECH = r"(?i)^\s*[\[(*](applause|laughter|music|silence|inaudible|noise|clapping)[^\])*]*[\])*]\s*$"
