"""Labelled exemplars of residue: texts of which copies, with other names and numbers, should be left out.

Fixed values. In an exemplar ``NAME`` stands for any product, host, path,
number or other thing that differs from case to case, and ``BLANK`` for an
unfilled blank in any of the writings of ``BLANK_STYLES``. Alternatives are
exemplars of their own.
"""

from __future__ import annotations

MESSAGES = """
<html><head><title>Maintenance</title></head><body><h1>We'll be back soon</h1><p>NAME is down for upkeep until NAME.</p></body></html>
<html><head><title>Down for maintenance</title></head><body><h1>Scheduled maintenance</h1><p>The service is unavailable while we update. Please check back later.</p></body></html>
Whoops, something went wrong on our side. Reference: NAME Try again in NAME minutes.
Something went wrong. Please try again later. An unexpected error occurred.
<!DOCTYPE html> <html><head><title>Sign in</title></head><body> <form action="/session" method="post"> <h1>Sign in to NAME</h1> <p>You must be signed in to see this file.</p> <input name="login"><input name="pw" type="password"> </form></body></html>
<!DOCTYPE html> <html><head><title>Sign in</title></head><body> <form action="/session" method="post"> <h1>Sign in to NAME</h1> <p>This project is private.</p> <input name="login"><input name="pw" type="password"> </form></body></html>
<!DOCTYPE html> <html><head><title>Sign in</title></head><body> <form action="/session" method="post"> <h1>Sign in to NAME</h1> <p>Your session has ended. Log in again.</p> <input name="login"><input name="pw" type="password"> </form></body></html>
<!doctype html><html><head><title>Log in</title></head><body><form method="post"><label>Username</label><input name="username"><label>Password</label><input name="password" type="password"><button>Log in</button></form></body></html>
<!doctype html><html><head><meta charset="utf-8"><title>NAME</title><script src="/static/main.NAME.js"></script></head><body><noscript>You need to enable JavaScript to run this app.</noscript><div id="root"></div></body></html>
You need to enable JavaScript to run this app.
This page requires JavaScript. Please enable JavaScript in your browser settings and reload the page.
Please turn on JavaScript and cookies in your browser, then reload NAME.
We have noticed that scripts do not run in this browser. Enable them or change to a supported one to go on using NAME.
NAME | Scripts are off To read this file, allow scripts for NAME and try again.
<h1>Unsupported browser</h1> <p>NAME needs scripts, which are blocked here. Allow them to display the source.</p>
<h1>Unsupported browser</h1> <p>NAME needs scripts, which are blocked here. Activate them to display the source.</p>
Your browser is not supported. Please upgrade to a current version of your browser to continue.
Internal error while serving NAME Traceback (most recent call last): File NAME, line NAME, in NAME NAME(request) NAME: upstream gave no answer request NAME
<!-- NAME --> upstream connect error or disconnect before headers. reset reason: connection failure
<!-- NAME --> upstream connect error or disconnect before headers. reset reason: overflow
<!-- NAME --> upstream connect error or disconnect before headers. reset reason: timeout
<!-- NAME --> upstream connect error or disconnect before headers. reset reason: connection termination
ssh: connect to host NAME port NAME: Connection refused
ssh: connect to host NAME port NAME: Connection timed out
<html><body bgcolor=white><h3>Web filter</h3><p>The address NAME was blocked by policy <b>NAME</b>. Category: NAME. Ask your administrator if you need it.</p></body></html>
<?xml version="1.0" encoding="UTF-8"?> <Error><Code>ExpiredToken</Code><Message>Access denied</Message><RequestId>NAME</RequestId></Error>
<?xml version="1.0" encoding="UTF-8"?> <Error><Code>SlowDown</Code><Message>Access denied</Message><RequestId>NAME</RequestId></Error>
<?xml version="1.0" encoding="UTF-8"?> <Error><Code>ExpiredToken</Code><Message>The key does not exist</Message><RequestId>NAME</RequestId></Error>
<?xml version="1.0" encoding="UTF-8"?> <Error><Code>NoSuchKey</Code><Message>The key does not exist</Message><RequestId>NAME</RequestId></Error>
<?xml version="1.0" encoding="UTF-8"?> <Error><Code>AccessDenied</Code><Message>Access denied</Message><RequestId>NAME</RequestId></Error>
<?xml version="1.0" encoding="UTF-8"?> <Error><Code>SlowDown</Code><Message>The key does not exist</Message><RequestId>NAME</RequestId></Error>
The page you are looking for does not exist, or you have no right to see it.
The requested page could not be found.
La página solicitada no existe. Código NAME
Diese Seite wurde nicht gefunden (Fehler NAME).
La page demandée est introuvable (erreur NAME).
La page demandée n'existe pas. Erreur NAME
La pagina richiesta non esiste. Errore NAME
A página solicitada não existe. Erro NAME
De gevraagde pagina bestaat niet. Fout NAME
{ "error": {"code": NAME, "reason": "rate limit exceeded for NAME", "retry_after": NAME} }
{ "error": {"code": NAME, "reason": "download allowance exceeded for NAME", "retry_after": NAME} }
{ "error": {"code": NAME, "reason": "request quota exceeded for NAME", "retry_after": NAME} }
{ "error": {"code": NAME, "message": "too many requests", "retry_after": NAME} }
<html><head><title>Just a second</title></head><body><h1>NAME</h1><p>Checking that your connection is safe before going on.</p><p>Ray NAME</p></body></html>
<html><head><title>Just a second</title></head><body><h1>NAME</h1><p>Verify that you are not a robot to continue.</p><p>Ray NAME</p></body></html>
<html><head><title>Just a moment</title></head><body><p>Checking your browser before you proceed. Please wait.</p><p>Ray NAME</p></body></html>
curl: (NAME) The requested URL returned error: NAME
wget: server returned error: HTTP/NAME NAME
fatal: repository NAME not found
fatal: could not read from remote NAME
Oops! We can't find that NAME. Go back to the start page.
Sorry, we could not find the page you asked for. Go back to the home page.
HTTP/NAME NAME Internal Server Error Server: NAME
Error NAME - Access denied. You do not have permission to view this file.
Please wait while we check your browser. You will be redirected when it is done.
Your request is being processed. Please wait.
This file is no longer available. It was removed by its owner.
<noscript>JavaScript must be enabled to run this app.</noscript>
<noscript>Your browser must run scripts to show this page.</noscript>
<noscript>Veuillez activer JavaScript pour utiliser cette application.</noscript>
<noscript>Bitte aktivieren Sie JavaScript, um diese Anwendung zu nutzen.</noscript>
<noscript>Active JavaScript para usar esta aplicación.</noscript>
""".strip().splitlines()

# Names of refusals and failures; with their codes they stand alone or in the frames below.
STATUS = [
    "Bad Request", "Unauthorized", "Payment Required", "Forbidden", "Not Found", "Method Not Allowed", "Request Timeout", "Conflict", "Gone", "Too Many Requests", "Unavailable For Legal Reasons",
    "Internal Server Error", "Not Implemented", "Bad Gateway", "Service Unavailable", "Gateway Timeout",
]
STATUS_FRAMES = [
    "NAME STATUS",
    "/* STATUS (NAME) */",
    "# NAME STATUS <p>The server at NAME could not hand out <code>NAME</code>.</p>",
    '{"message": "STATUS", "status": NAME, "help": NAME}',
    "<html> <head><title>NAME STATUS</title></head> <body> <center><h1>NAME STATUS</h1></center> <hr><center>NAME</center> </body> </html>",
    "wget: server returned error: HTTP/NAME NAME STATUS",
    "<!-- NAME --> STATUS",
    "HTTP/NAME NAME STATUS Server: NAME",
]

FILLER_SENTENCES = """
Sample text.
Text text text.
Your content goes here.
Your text goes here.
Placeholder paragraph.
Placeholder text.
Describe this section.
Add your description here.
Insert code here.
Insert text here.
To be written.
Coming soon.
Dummy text.
Content coming soon.
""".strip().splitlines()

# Sentences like those above come repeated, under headings and in comments such as these.
FILLER_FRAME = "# Title ## Subtitle ### Heading <html><body><h1>Heading</h1><p> </p></body></html> body { } /* dummy */ // insert code here // placeholder - item"

# Words of pseudo-Latin filler. Further ones are learned from the corpus (``residue.companions``).
FILLER_LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation "
    "ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat "
    "non proident sunt culpa qui officia deserunt mollit anim id est laborum"
)

# Entries of lists that were never written, and their heads.
FILLER_LIST = "TODO item tbd xxx todo coming soon to be written fixme n/a"

# What a blank may be for.
BLANK_FIELDS = (
    "year|full name|name|author|author name|authors|your name|owner|maintainer|maintainer name|maintainer email|email|author email|contact|contact email|project|project name|project title|module name|"
    "package name|package|module|version|release|title|page title|doc title|description|short description|project description|organization|organisation|company|company name|holder|copyright holder|date"
).split("|")

# Writings of a blank: what stands before and after its name.
BLANK_STYLES = [
    ("{{", "}}"), ("{{ cookiecutter.", "}}"), ("{%", "%}"), ("<%=", "%>"), ("<%", "%>"), ("<<", ">>"), ("#{", "}"), ("${", "}"), ("${project.", "}"), ("((", "))"), ("@@", "@@"), ("@", "@"), ("%", "%"), ("$", "$"),
    ("__", "__"), ("[", "]"), ("[insert ", "]"), ("[your ", "]"), ("<your ", ">"), ("<insert ", ">"), ("<", " here>"), ("[", " here]"), ("REPLACE_WITH_", ""), ("YOUR_", ""), ("INSERT_", ""), ("xxx-", "-xxx"), ("TODO_", ""),
]

# Lines of project skeletons in which a blank stands.
BLANK_LINES = """
Copyright (c) BLANK BLANK
Copyright (c) NAME BLANK
Copyright BLANK BLANK
NAME - part of BLANK
part of the BLANK project
version BLANK of BLANK
version NAME of BLANK
version: BLANK
author: BLANK
maintainer: BLANK
contact BLANK about the NAME
written by BLANK
<head><title>BLANK</title></head>
title: BLANK
"name": BLANK,
"author": BLANK,
"version": BLANK,
"description": BLANK,
name = BLANK
# BLANK
BLANK
welcome to BLANK
""".strip().splitlines()
