"""What each weakness class means and how to mend it, in our own words."""
from __future__ import annotations

# cwe number: (category, what is wrong, what to do)
WEAKNESSES = {
    15: ("configuration", "a setting taken from outside steers the program", "Check settings read from the environment before use."),
    20: ("injection", "outside input is used unchecked", "Check and clean outside input before using it."),
    22: ("path-traversal", "a file path is built from parts an attacker may choose", "Resolve the path and make sure it stays in an allowed folder."),
    78: ("injection", "an operating-system command is built or run unsafely", "Pass a fixed program and a list of arguments, without a shell."),
    79: ("xss", "markup is written without escaping", "Write text content, or escape and sanitise markup first."),
    89: ("injection", "a database statement is put together from text", "Use a parameterised statement."),
    94: ("injection", "code or a template is made from data", "Keep data out of code and templates."),
    95: ("injection", "text is evaluated as code", "Parse the text with a safe parser instead of evaluating it."),
    98: ("injection", "a file chosen at run time is included as code", "Include only files from a fixed list."),
    119: ("memory", "memory may be accessed out of bounds", "Check sizes and bounds, and update the library."),
    134: ("injection", "a format string comes from data", "Use a constant format string."),
    200: ("exposure", "internal details are exposed", "Check that this detail is meant to be public."),
    203: ("crypto", "timing may reveal a secret", "Use constant-time operations and update the library."),
    248: ("errors", "an error can end the program", "Catch and handle the error."),
    252: ("errors", "a result is not checked", "Check the result."),
    287: ("auth", "a sign-in check can be passed by", "Verify signatures and claims on every request."),
    295: ("crypto", "a certificate is not verified", "Verify certificates and host names."),
    312: ("exposure", "a secret is stored in clear text", "Keep secrets in a protected store."),
    319: ("crypto", "data travels unencrypted", "Use TLS."),
    327: ("crypto", "a weak algorithm is used", "Use SHA-256 or better, or AES-GCM."),
    328: ("crypto", "a weak hash is used", "Use SHA-256 or better."),
    338: ("crypto", "random numbers can be predicted", "Use a cryptographic random source."),
    345: ("auth", "the origin of a message is not checked", "Compare the origin with the expected one."),
    346: ("auth", "any origin is allowed", "List the allowed origins."),
    362: ("concurrency", "shared state may be changed at the same time", "Guard shared state with a lock or a channel."),
    367: ("concurrency", "a check and its use can be split by a change", "Open first and check the open handle."),
    377: ("files", "a temporary file is created unsafely", "Use the library's safe temporary files."),
    391: ("errors", "an error is dropped", "Handle the error."),
    400: ("availability", "input can use up resources or stop the program", "Bound the work and handle bad input."),
    401: ("memory", "memory is never freed", "Let the owner free it."),
    415: ("memory", "memory may be freed twice", "Let the owner free it."),
    457: ("memory", "memory is used before it is set", "Set memory before reading it."),
    466: ("memory", "a raw pointer leaves the type system", "Stay with safe types, or check bounds."),
    476: ("memory", "a pointer may be null", "Check the pointer first."),
    489: ("configuration", "debugging is left on", "Switch debugging off in production."),
    502: ("deserialization", "untrusted data is turned into objects", "Read data formats without code, and check them."),
    506: ("supply-chain", "a package is known to be harmful", "Remove the package."),
    546: ("comments", "a comment gives away something sensitive", "Remove it from the comment."),
    601: ("redirect", "a redirect goes where input says", "Redirect only to listed places."),
    611: ("injection", "markup may pull in outside entities", "Switch external entities off."),
    614: ("cookies", "a cookie lacks its protections", "Set the secure and http-only marks."),
    617: ("errors", "a check may be compiled out or stop the program", "Raise a proper error."),
    674: ("availability", "nesting is not bounded", "Bound the depth."),
    681: ("numbers", "a number is cut on conversion", "Check the range first."),
    693: ("configuration", "a protection is switched off", "Leave the protection on."),
    732: ("files", "a file is open to everyone", "Give only the rights needed."),
    754: ("errors", "a failure is not handled", "Handle the failing case."),
    758: ("memory", "the compiler's checks are switched off", "Keep unsafe code small and reviewed."),
    772: ("resources", "a resource is held too long", "Release it in the loop's own scope."),
    798: ("secrets", "a secret is written in the code", "Read secrets from the environment or a secret store."),
    828: ("concurrency", "a signal handler does unsafe work", "Only set a flag in the handler."),
    829: ("supply-chain", "code from an unknown source is used", "Pin and verify dependencies."),
    838: ("encoding", "an encoding can be mistaken", "Normalise before comparing."),
    843: ("memory", "a value is read as another type", "Use a checked conversion."),
    915: ("injection", "object attributes are set from data", "Copy listed attributes only."),
    918: ("ssrf", "a request goes where input says", "Allow only listed hosts."),
    942: ("auth", "the cross-origin policy is too wide", "List the allowed origins."),
    1104: ("supply-chain", "a package is no longer cared for", "Move to a maintained package."),
    1321: ("injection", "an object's prototype can be changed", "Refuse prototype keys, or use a map."),
    1327: ("configuration", "a service listens on every interface", "Bind to one address."),
}
