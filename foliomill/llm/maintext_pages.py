"""The labelled table of the HTML extraction: small pages written by hand, each part labelled main or other.

Pages with and without article markup, with short and long paragraphs, lists, linked paragraphs, and the usual
surroundings.  The tree that is grown on their blocks is the same everywhere.
"""

PAGES = [
    # News page with full markup.
    """<html><head><title>Bridge reopens</title></head><body><div data-label="other"><header><a href="/">The Valley Post</a><p>Your paper since 1901</p></header>
<nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather and travel</a></li></ul></nav>
<div class="ad">Save a third on garden chairs until Sunday, only at our shop by the station.</div></div>
<article data-label="main"><h1>Bridge reopens after repairs</h1><p>The old bridge over the mill stream was opened again on Friday after eleven months of repairs.</p><p>Traffic flows.</p>
<p>Engineers replaced four of the nine arches and drained the foundations, which had been under water since the flood of last spring.</p><ul><li>Four arches new</li><li>Two lanes</li></ul>
<p>More in <a href="/r">the report of the county council on all bridges</a>.</p></article>
<div data-label="other"><aside><h3>Most read</h3><ul><li><a href="/1">Storm tears roof off school</a></li><li><a href="/2">Mayor will not stand again</a></li></ul></aside>
<section class="comments"><h3>Comments</h3><p>I drove over it this morning and the new surface is so much quieter than the cobbles were before, well done to everybody involved.</p><p>About time!</p></section>
<footer><p>Copyright The Valley Post. All rights reserved. No part may be copied without permission of the publisher.</p></footer></div></body></html>""",
    # A weblog in divisions named by class and id.
    """<body><div id="header" data-label="other"><h1><a href="/">Notes on bread</a></h1><p>by a baker who writes when the oven is warm</p></div>
<div id="content" data-label="main"><h2>Rye and patience</h2><p>Rye does not rise like wheat. It has little gluten, so the dough stays heavy and sticks to everything.</p><p>Wait.</p>
<blockquote>Time is the cheapest ingredient in the bakery.</blockquote><p>After sixteen hours the crumb is moist, the crust dark, and the loaf keeps for a week.</p><table><tr><td>Flour</td><td>500 g</td></tr></table></div>
<div id="sidebar" data-label="other"><h3>About me</h3><p>I have been baking bread in a small town in the north for more than twenty years and teach on weekends.</p><form><p>Subscribe to the letter and never miss a loaf again.</p><button>Go</button></form></div>
<div class="cookie-notice" data-label="other"><p>This site uses cookies to give you the best experience. By going on you accept our terms.</p><a href="#">Accept</a></div>
<div id="footer" data-label="other">Powered by flour, water and salt.</div></body>""",
    # No helpful names at all.
    """<body><table data-label="other"><tr><td><a href="/">Home</a></td><td><a href="/a">Archive of all issues</a></td><td><a href="/c">Contact</a></td></tr></table>
<div data-label="main"><p>In the third year of the drought the farmers of the plain began to dig deeper wells, and the first of them ran dry before the harvest was in.</p>
<p>The council met in the schoolhouse and talked until after midnight, but there was no agreement on who should be allowed to pump and when.</p>
<p>It was the widow from the upper farm who at last proposed the rota that is still kept today, fifty years later, by the grandchildren of those who sat there.</p></div>
<div data-label="other"><a href="/p">Previous</a> <a href="/n">Next</a></div><div data-label="other">Site map <a href="/m">here</a></div><div data-label="other">Terms of use</div></body>""",
    """<body><p data-label="other"><a href="/">Start</a> | <a href="/faq">Questions</a> | <a href="/imp">Imprint</a></p><h1 data-label="main">How to season a pan</h1>
<p data-label="main">Wash the pan with hot water and dry it well, since a wet pan rusts within the hour.</p><p data-label="main">Rub a few drops of oil into the iron until it no longer shines, inside and outside, and wipe off what is left.</p>
<p data-label="main">Put it into the oven at full heat for an hour and let it cool down with the door closed. Do this three times.</p>
<p data-label="other">Tags: <a href="/t1">iron</a>, <a href="/t2">kitchen</a>, <a href="/t3">care</a></p><p data-label="other">Back to top</p><ul data-label="other"><li><a href="/x">How to sharpen a knife</a></li><li><a href="/y">How to oil a board</a></li></ul></body>""",
    # Shop-like page around a description in main.
    """<body><div class="topbar banner" data-label="other">Free delivery on all orders over fifty this week, use the code at the till before Sunday night.</div>
<nav class="breadcrumbs" data-label="other"><a href="/">Home</a> / <a href="/l">Lamps</a></nav><main data-label="main"><h1>Desk lamp</h1><p>Steel, matt green.</p>
<p>The arm turns in all directions and stays where it is put, thanks to two springs that were first made for carriages.</p><dl><dt>Height</dt><dd>48 cm</dd><dt>Weight</dt><dd>2 kg</dd></dl></main>
<div class="related" data-label="other"><h2>You may also like</h2><p>A floor lamp with the same springs and a shade of linen, made to order in nine colours by the same small firm.</p></div>
<div role="contentinfo" data-label="other"><p>Prices include tax. Errors excepted. We are a family business and answer all letters within two days.</p></div></body>""",
    # Advert and newsletter form inside the article.
    """<article data-label="main"><h1>Night trains return</h1><p>Sleeping cars will run again between the two capitals from the summer on.</p><div class="advert" data-label="other"><p>Book your holiday by the sea now and pay only half the price for children under twelve years.</p></div>
<p>Tickets are sold from March.</p><form data-label="other"><p>Get the news of the week by mail, every Friday, free of charge and with no obligation at all.</p></form>
<p>The last night train on the line was taken out of service nine years ago, when cheap flights had drawn off most of its passengers.</p><div class="share" data-label="other"><a href="/f">Share</a> <a href="/m">Mail</a></div></article>""",
    # Forum-like thread: the post is the article, answers are reader comments.
    """<body><div class="menu" data-label="other"><a href="/">Board</a> <a href="/new">New</a></div><div class="post" data-label="main"><p>Does anybody know how to free a seized nut on an old pump?</p><p>Heat did not help.</p></div>
<div id="replies" data-label="other"><div class="reply"><p>Soak it overnight in oil and tap it gently from all sides before you try again with a long lever.</p></div><div class="reply"><p>Cut it.</p></div></div></body>""",
    """<body><div class="wrapper"><div class="nav-main" data-label="other"><ul><li><a href="/1">Themen</a></li><li><a href="/2">Orte</a></li></ul></div><div class="entry-content" data-label="main"><p>Kurz.</p><p>Der Nebel lag den ganzen Tag im Tal und erst am Abend sah man vom Turm aus wieder das andere Ufer.</p>
<p>Ja.</p><h2>Danach</h2><p>Die Boote blieben im Hafen.</p></div><div class="widget" data-label="other"><p>Das Wetter morgen: Nebel im Tal, auf den Bergen sonnig und mild, dazu schwacher Wind aus Osten.</p></div><div class="comment-list comments" data-label="other"><p>Schön geschrieben, ich war an dem Tag auch dort oben und habe nichts gesehen.</p></div></div></body>""",
    # Short pages.
    """<body><nav data-label="other"><a href="/">A</a></nav><article data-label="main"><h1>Note</h1></article><footer data-label="other">End of page</footer></body>""",
    """<body><div class="notice" data-label="other">Maintenance tonight.</div><main data-label="main"><p>Closed.</p></main><div class="login" data-label="other"><p>Log in to read the rest of this text and many more in our archive.</p></div></body>""",
    """<body><div data-label="other"><a href="/">Index of all pages</a></div><p data-label="main">The lighthouse was built of granite from the island itself, and the stones were cut by hand during two winters.</p><p data-label="main">Its lamp could be seen from nineteen miles away on a clear night, further than any other on that coast.</p><div data-label="other">Print this page</div></body>""",
    """<body><ul data-label="other"><li><a href="/a">One</a></li><li><a href="/b">Two and three</a></li></ul><article data-label="main"><p><a href="/s">All of this first paragraph is a link to the sources of the text</a></p><p>See <a href="/q">there</a>.</p><ol><li><a href="/r1">Source one, a book of letters</a></li><li>Source two</li></ol></article><p data-label="other"><a href="/z">More</a></p></body>""",
    # Plain pages with paragraphs of middling length.
    """<body><div data-label="other"><a href="/">Home</a> <a href="/l">List of all recipes</a></div><h1 data-label="main">Lentil soup for six</h1><p data-label="main">Soak the lentils for an hour and throw the water away.</p>
<p data-label="main">Fry an onion and two carrots in oil until they are soft and a little brown at the edges.</p><p data-label="main">Add the lentils, cover them with stock and let it all simmer for half an hour.</p><div data-label="other">Rate this recipe</div><div data-label="other"><a href="/p">Printer version</a></div></body>""",
    """<body><div data-label="other">You are here: <a href="/">Start</a> &gt; <a href="/g">Garden</a></div><h2 data-label="main">Pruning the old pear</h2><p data-label="main">Pears bear on wood that is three years old or more.</p><p data-label="main">Cut out what crosses, and leave the spurs on the outside of the crown alone.</p>
<h2 data-label="main">When to begin</h2><p data-label="main">A dry day in February is best, before the sap begins to rise in the trunk.</p><p data-label="main">In wet years wait until March.</p><p data-label="other"><a href="/1">Apple</a> <a href="/2">Plum</a> <a href="/3">Quince and medlar</a></p><p data-label="other">All rights reserved.</p></body>""",
    # Main parts that by their words and links alone look like menus.
    """<article data-label="main"><p>Gone fishing.</p></article>""",
    """<body><article data-label="main"><h1>Links of the week</h1><ul><li><a href="/1">A map of lost rivers</a></li><li><a href="/2">Why bells crack</a></li><li><a href="/3">Ten kinds of fog</a></li><li><a href="/4">The last lamplighter</a></li><li><a href="/5">Salt</a></li><li><a href="/6">On ferries</a></li>
<li><a href="/7">Letters from a weather station in the far north</a></li><li><a href="/8">Maps of sand</a></li></ul><p><a href="/all">All weeks</a></p></article><div data-label="other"><a href="/">Home</a></div><div data-label="other"><a href="/c">Contact</a></div><div data-label="other"><a href="/i">Imprint of this site</a></div></body>""",
    """<body><div data-label="other"><a href="/">Start</a></div><div class="content" data-label="main"><h2>Contents</h2><ol><li><a href="#1">Beginnings</a></li><li><a href="#2">The long winter</a></li><li><a href="#3">Thaw</a></li><li><a href="#4">Harvest</a></li><li><a href="#5">Notes</a></li></ol><table><tr><td><a href="/a">Anna</a></td><td>1</td></tr></table></div><div data-label="other"><a href="/t">Top</a></div></body>""",
]
