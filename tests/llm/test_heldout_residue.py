"""Residue and content written for this test only: none of these texts stands among the exemplars."""

from folioform.llm.exemplars import RESIDUE
from folioform.llm.residue import COVERAGE, ResidueIndex, exemplar_tokens, tokens

HELD_OUT = [
    "503 Service Unavailable: no server is available to handle this request", "HTTP Error 404. The requested resource is not found.", "Sorry, the page you were looking for cannot be found", "500 - Internal server error. There is a problem with the resource you are looking for.",
    "502 Bad Gateway cloudflare", "Error 403 Forbidden You don't have permission to access this resource", "Access Denied. You do not have permission to view this directory", "Your session has expired. Please log in.",
    "Too many requests. Please retry later", "Oops! An unexpected error occurred", "This site can’t be reached. took too long to respond", "ERR connection refused by host", "Fatal error: Uncaught exception in index.php line 20", "Traceback (most recent call last): File main.py",
    "Warning: undefined variable $x in page.php on line 3", "Uncaught TypeError: Cannot read properties of undefined", "Cannot POST /api/v2/verses", "We're sorry, something went wrong on our end", "Gateway Timeout 504", "Please enable JavaScript and cookies to continue", "JavaScript is disabled. Enable it in your settings",
    "This website requires JavaScript to work", "Bitte aktivieren Sie JavaScript in Ihrem Browser", "Veuillez activer JavaScript dans votre navigateur", "Пожалуйста, включите JavaScript", "Your browser has JavaScript turned off", "Scripts are blocked by your browser", "<noscript>Please turn on scripts</noscript>", "Checking your browser before accessing the library",
    "Lorem ipsum dolor sit amet", "sed do eiusmod tempor incididunt ut labore et dolore magna aliqua", "Dummy text for the heading", "[INSERT CHAPTER HERE]", "[Your name here]", "{{ chapter.title | upper }}", "{% for v in verses %}", "<%= @book.name %>", "${verse.text}", "%%TITLE%%", "Hello {first_name}, welcome", "Dear {customer},", "<<LAST_NAME>>", "*|FNAME|*",
    "Your text goes here", "__CHAPTER_TITLE__", "The chapter undefined undefined", "Sample text for layout", "[object Object]",
]
CONTENT = [
    "And the {man} went out from the city", "he gave 500 men of the tribe", "In the 404 cities nothing was lost", "<<To the chief Musician>> Hear my cry", "and he {himself} cried", "The scribe wrote the script of the law", "They sought the page among the scrolls, but a servant kept it", "the gate was forbidden to the stranger", "the bad servant stood at the gateway",
    "They were denied access to the temple", "And he said [unto them], come", "Enable thy servant to speak", "the session of the elders was long", "He turned on his way and returned home", "the connection of the tribes", "He sold it for $30 and {a} lamb", "Seek, and ye shall find; it was not found", "the text to follow the reading is a psalm of praise", "soon he was coming to the city", "he required of the scribes the scrolls",
    "the error of the prophet was 500 cubits", "the lord opened the book and found the place", "the old man was the server of tables and an internal grief held him",
]


def test_held_out_texts():
    ix = ResidueIndex({w: 400 for w in "the of and in a to was he is it for that with not his by on were from".split()}, 1000)
    missed = [t for t in HELD_OUT if ix.coverage(t) < COVERAGE]
    wrong = [t for t in CONTENT if ix.coverage(t) >= COVERAGE]
    exemplars = {tuple(exemplar_tokens(r)) for r in RESIDUE}
    assert not [t for t in HELD_OUT if len(tokens(t)) > 1 and tuple(tokens(t)) in exemplars]
    assert len(missed) <= 0.2 * len(HELD_OUT), missed
    assert len(wrong) <= 0.05 * len(CONTENT), wrong
