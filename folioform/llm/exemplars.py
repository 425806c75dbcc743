"""Labelled exemplars of template residue, filler, error pages and script notices, and of content that resembles them.

``_`` stands for a variable part. Template syntax is written as the shape token it is read as (see residue.SHAPES).
"""

from __future__ import annotations

#: Words of the customary filler text, which occurs in any order.
LOREM = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim
veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse
cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
curabitur pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas vestibulum mattis ullamcorper porta gravida faucibus"""

#: Texts by class: errors, script notices, filler, templates.
RESIDUE = [
    # errors
    "<code> not found _ is not on this server", "error <code> _ could not be loaded", "error <code> module _ could not be loaded", "error <code> page not found", "<code> page not found", "erreur <code> le chapitre _ est introuvable",
    "erreur <code> page introuvable", "ошибка <code> страница <n> не найдена", "ошибка <code> страница не найдена", "страница не найдена _ <n>", "página no encontrada _ <n>", "error <code> página no encontrada", "página não encontrada _ <n>", "seite nicht gefunden _ <n>",
    "fehler <code> seite nicht gefunden", "the page you requested _ <n> does not exist", "the requested url _ was not found on this server", "access denied reference <n>", "access denied you do not have permission", "zugriff verweigert", "too many requests please retry in <n> seconds",
    "too many requests", "sql error near _ no such table", "your session has expired log in again <n>", "your session has expired please log in again", "fatal error uncaught exception in _ php line <n>", "warning undefined variable in _ on line <n>", "traceback most recent call last _",
    "traceback most recent call last keyerror _", "upstream connect error reset reason timeout <n>", "upstream connect error or disconnect before headers reset reason connection failure", "<tag> <tag> <code> service unavailable </tag> <tag> _ </tag> </tag>", "<tag> <tag> <code> bad gateway </tag> <tag> _ </tag> </tag>",
    "<tag> <tag> <code> internal server error </tag> <tag> _ </tag> </tag>", "<code> internal server error", "<code> service unavailable", "<code> bad gateway", "<code> gateway timeout", "<code> forbidden", "internal server error please try again later", "service temporarily unavailable please try again later", "connection timed out after <n> ms", "σφάλμα <code> η σελίδα δεν βρέθηκε", "שגיאה <code> הדף לא נמצא", "nullpointerexception at _ java <n>", "segmentation fault core dumped",
    "<code> not found nginx", "<code> not found apache", "not found the requested url was not found on this server", "page introuvable", "cette page n existe pas", "la page demandée n existe pas", "diese seite existiert nicht", "die angeforderte seite wurde nicht gefunden", "la página solicitada no existe", "esta página no existe",
    "a página solicitada não existe", "pagina non trovata", "pagina niet gevonden", "запрашиваемая страница не найдена", "η σελίδα δεν υπάρχει", "הדף המבוקש לא נמצא", "<route>", "this page isn t working", "this page is not available", "this site can t be reached", "this page can t be displayed", "the page you are looking for", "page cannot be found",
    "error <code> web server is down", "web server is down", "origin is unreachable", "connection timed out", "connection refused", "connection reset by peer", "could not connect to database", "error establishing a database connection", "database error _", "internal server error", "bad request", "request entity too large", "something went wrong", "an error occurred while processing your request",
    "an unexpected error occurred", "oops something went wrong", "une erreur est survenue", "une erreur s est produite", "ein fehler ist aufgetreten", "ha ocurrido un error", "ocorreu um erro", "произошла ошибка", "ошибка сервера", "erreur interne du serveur", "interner serverfehler", "error interno del servidor", "erro interno do servidor", "accès refusé", "acceso denegado", "acesso negado", "доступ запрещен",
    "permission denied", "unauthorized access", "please verify you are a human", "session expired", "syntax error unexpected _", "undefined index _", "stack trace _", "nullreferenceexception", "typeerror cannot read property _ of undefined", "cannot read properties of undefined", "failed to load resource", "file not found", "module not found", "rate limit exceeded",
    # script notices
    "you must turn on js to continue", "turn on js", "enable js", "js is disabled", "js is required", "turn on javascript", "enable javascript", "activate javascript", "javascript must be enabled", "javascript required", "requires javascript", "without javascript", "javascript is not enabled", "javascript is turned off", "scripts are disabled", "scripts are blocked", "scripts are required",
    "activer javascript", "activez javascript", "javascript est désactivé", "javascript aktivieren", "javascript ist deaktiviert", "activar javascript", "active javascript", "habilitar javascript", "javascript está desactivado", "javascript está desativado", "включите javascript", "включить javascript", "javascript отключен", "abilita javascript", "schakel javascript in",
    "please enable javascript to view _", "please enable javascript in your browser", "you need to enable javascript to run this app", "javascript is disabled in your browser <n>", "javascript is required to view this page", "this site requires javascript", "для чтения _ включите javascript в браузере",
    "este sitio requiere javascript _", "este site requer javascript", "por favor active javascript", "habilite javascript en su navegador", "bitte aktivieren sie javascript um _ zu lesen", "diese seite benötigt javascript", "veuillez activer javascript pour lire _", "ce site nécessite javascript", "ative o javascript no navegador", "your browser blocks scripts so _ cannot be shown",
    "checking your browser before opening _ scripts required", "checking your browser before accessing _", "this reader needs scripts allow them for _", "<noscript> turn on scripts to read _ </noscript>", "<noscript> _ </noscript>", "turn on scripts to read _", "enable cookies and scripts to continue", "ενεργοποιήστε το javascript", "יש להפעיל javascript",
    # filler
    "lorem ipsum", "texto de relleno <n>", "dummy verse <n> for layout only", "dummy text for layout only", "test test <n> test", "blindtext für _ bitte ersetzen", "blindtext bitte ersetzen", "texte provisoire pour _ à remplacer", "texte provisoire à remplacer", "asdf asdf asdf", "tbd text to follow",
    "xxxx xxxx xxxx", "coming soon", "<placeholder>", "qwerty qwerty qwerty", "sample text goes here", "your text here", "insert text here", "placeholder text", "foo bar baz", "bla bla bla", "texto provisório substituir", "текст заглушка", "заглушка для _",
    "placeholder for _ text", "this is placeholder text", "this is dummy text", "dummy text", "sample text", "filler text", "texte factice", "texte de remplissage", "platzhaltertext", "fülltext", "texto de ejemplo", "texto de exemplo", "texto de prueba", "testo segnaposto", "тестовый текст", "текст по умолчанию", "replace this text", "to be determined", "content goes here", "the quick brown fox jumps over the lazy dog",
    "under construction", "page under construction", "work in progress", "do not publish", "draft only _ replace",
    # templates
    "<slot>", "<goes-here>", "<object>", "undefined undefined", "nan nan nan",
]

#: Content that shares words with residue. A window is residue only if no content exemplar fits it better.
CONTENT = [
    "the error of _ was great and the page of the scroll could not be opened", "the scripts of _ were required of the scribes", "in the _ year _ was sought and was not found", "it is not found in the copy of _ that <code> scribes wrote", "it is not found in the copy of _ that <n> scribes wrote",
    "_ was the price of the field in the later copy", "a song of _", "to the chief singer", "end of the reading", "a song of ascents",
]
